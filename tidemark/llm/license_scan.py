"""Licence scan by Dice coefficient over word bigrams (DataFrame functions only).

A text's units are its lines, its sentences, its paragraphs (blank-line blocks) and the whole text. A
unit and a template are normalised (lower case, anything but letters and digits becomes one space) and
compared as sets of word bigrams: dice = 2 |A & B| / (|A| + |B|). Besides, every stretch of the text's
normalised words, over lines and sentences, of up to (2-least)/least of a template's words is compared with
it; the best stretch of a template is a unit too where it beats the other units of its licence. A dice of
`least` or more bounds the unit's size to between least/(2-least) and (2-least)/least of the template's and
asks for at least need = ceil(least/(2-least) * |T|) shared bigrams. So a unit must hold one of any words
that over |T| - need of the template's bigrams contain: texts with none of those words are left at once, a
template of which the text lacks that many bigrams next, and a start with too few in reach last; all
without loss. Stretches are then tried at every start and end by one pass from each start.

Templates are short notices, standard headers, whole short licences, and of the long licences the paragraph
that names them, which the whole text holds as well.

Defined results: null, empty or one-word texts match nothing; the best licence of a text is the one with
the largest dice, ties by name; repeated rows are judged alike; an empty table gives an empty result;
docs' own columns pass through, one named like ours gives way.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
    OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission. """
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
    EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CC = (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"))


def _gnu_header(kind: str, name: str, version: str) -> str:
    return f"""This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as
        published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This
        {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""


#: Notices, headers and texts by which texts state their licence; a licence may have several.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. """ + _MIT_WARRANTY),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_CLAUSES + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_CLAUSES + _BSD_THIRD + _BSD_WARRANTY),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    *((name, _gnu_header(*words)) for name, *words in (
        ("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"),
        ("AGPL-3.0", "program", "Affero General", "3"), ("LGPL-3.0", "library", "Lesser General", "3"),
    )),
    ("LGPL-3.0", """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU
        General Public License, supplemented by the additional permissions listed below."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    *((name, f"""By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this
        Creative Commons {full} 4.0 International Public License ("Public License").""") for name, full in _CC),
    *((name, f"This work is licensed under a Creative Commons {full} 4.0 International License.") for name, full in _CC),
    ("CC0-1.0", """Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of
        Affirmer's Copyright and Related Rights and associated claims and causes of action, whether now known or unknown"""),
    ("AGPL-3.0", "This program is licensed under the AGPL-3.0 license."),
    *((name, f"{how} under the {short}.") for how in ("This project is licensed", "Distributed") for name, short in (
        ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"), ("ISC", "ISC License"),
        ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    )),
)
LEAST = 0.8
#: Words of any prose: gates do without them where they can.
_PLAIN = set(
    """a above action all an and any are as at be being but by can charge code conditions copy data deal details direct do either event
    express file files fit following for form free from if in is it kind law library limited list loss made may met more must name names
    no nor not notice of on or other out party permit person persons prior purpose see sell shall so special subject terms that the
    theory this to under use useful version was way whom will with without work writing written you 0 1 2 3 4""".split()
)


def normalise(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def _normalised(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def template_bigrams(text: str) -> list[str]:
    w = _normalised(text).split(" ")
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def needed(size: int, least: float) -> int:
    """Bigrams that a matching unit shares with a template of `size` bigrams at least."""
    return math.ceil(least / (2 - least) * size - 1e-9)


def gates(templates, least: float) -> list[str]:
    """Words of which a matching unit must hold one: per template, words in more of its bigrams than may be lacking."""
    out: set[str] = set()
    for _, text in templates:
        left = set(template_bigrams(text))
        over = len(left) - needed(len(left), least)
        n = len(left)
        while n - len(left) <= over:
            # Words of other gates first, then those in most bigrams; short ones, common in any text, last.
            w = max({x for b in left for x in b.split(" ")}, key=lambda x: (x not in _PLAIN, x in out, sum(x in b.split(" ") for b in left), len(x), x))
            out.add(w)
            left = {b for b in left if w not in b.split(" ")}
    return sorted(out)


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, text: str = "text") -> DataFrame:
    """docs plus licence, dice and licence_units (array of unit, licence, dice), null or empty if none."""
    grams, found, words, stream, stretches = (common.free_name(docs, x) for x in ("grams", "found", "words", "stream", "stretches"))
    body = F.coalesce(F.col(text), F.lit(""))
    sets = [(name, template_bigrams(t), len(_normalised(t).split(" "))) for name, t in templates]
    gate = F.arrays_overlap(F.col(words), F.array(*map(F.lit, gates(templates, least))))
    pieces = F.array_distinct(
        F.concat(F.array(body), F.split(body, "\\n\\s*\\n"), F.split(body, "\\n"), F.split(body, "\\n|(?<=[.!?])\\s+"))
    )
    low = min(len(s) for _, s, _ in sets) * least / (2 - least)
    high = max(len(s) for _, s, _ in sets) * (2 - least) / least
    library = F.array(
        *[
            F.struct(
                F.lit(name).alias("licence"), F.array(*map(F.lit, s)).alias("grams"), F.lit(needed(len(s), least)).alias("need"),
                F.lit(math.floor((size - 1) * (2 - least) / least + 1e-9)).alias("reach"),
            )
            for name, s, size in sets
        ]
    )

    def bigrams(w: Column) -> Column:
        return F.array_distinct(
            F.when(
                F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
            ).otherwise(F.array().cast("array<string>"))
        )

    def dice(a: Column, b: Column) -> Column:
        return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))

    # Words first, as values: an expression inside a lambda is worked out anew for every element.
    split = F.transform(pieces, lambda u: F.struct(u.alias("unit"), F.split(normalise(u), " ").alias("w")))
    cells = F.filter(
        F.transform(split, lambda x: F.struct(x["unit"].alias("unit"), bigrams(x["w"]).alias("grams"))),
        lambda x: F.size(x["grams"]).between(math.ceil(low - 1e-9), math.floor(high + 1e-9)),
    )
    near = lambda x, t: (F.size(x["grams"]) >= F.size(t["grams"]) * (least / (2 - least)) - 1e-9) & (
        F.size(x["grams"]) <= F.size(t["grams"]) * ((2 - least) / least) + 1e-9
    )
    scored = F.flatten(
        F.transform(
            F.col(grams),
            lambda x: F.filter(
                F.transform(
                    F.filter(library, lambda t: near(x, t)),
                    lambda t: F.struct(
                        dice(x["grams"], t["grams"]).alias("dice"), t["licence"].alias("licence"), x["unit"].alias("unit")
                    ),
                ),
                lambda s: s["dice"] >= least,
            ),
        )
    )
    # Each bigram of the text in order, with the place of the same one before it (or -1).
    bound = lambda v, f: F.get(F.transform(F.array(v), f), 0)
    w = F.col(words)
    at = F.when(F.size(w) >= 2, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    placed = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)).alias("g"), i.alias("i"))))
    linked = bound(
        placed,
        lambda s: F.array_sort(
            F.transform(
                s,
                lambda x, k: F.struct(
                    x["i"].alias("i"), F.when((k > 0) & (F.get(s, k - 1)["g"] == x["g"]), F.get(s, k - 1)["i"]).otherwise(-1).alias("prev"), x["g"].alias("g")
                ),
            )
        ),
    )
    own = F.transform(F.col(stream), lambda x: x["g"])
    likely = bound(own, lambda g: F.filter(library, lambda t: F.size(F.array_intersect(g, t["grams"])) >= t["need"]))
    marked = F.transform(
        likely,
        lambda t: F.struct(
            t.alias("t"),
            F.transform(F.col(stream), lambda x: F.struct(x["i"].alias("i"), x["prev"].alias("prev"), F.array_contains(t["grams"], x["g"]).alias("hit"))).alias("marks"),
        ),
    )

    def ends(m: Column, s: Column) -> Column:
        """(dice, -start, bigrams) of the best stretch from start s."""
        zero = F.struct(*[F.lit(0).alias(c) for c in ("k", "size", "shared")], F.lit(0.0).alias("dice"), F.lit(0).alias("end"))

        def step(a: Column, x: Column) -> Column:
            new = (x["prev"] < s).cast("int")
            shared = a["shared"] + F.when(x["hit"], new).otherwise(0)
            d = F.when(x["hit"], 2.0 * shared / (a["size"] + new + F.size(m["t"]["grams"]))).otherwise(0.0)
            better = d > a["dice"]
            return F.struct(
                (a["k"] + 1).alias("k"), (a["size"] + new).alias("size"), shared.alias("shared"), F.greatest(a["dice"], d).alias("dice"),
                F.when(better, a["k"] + 1).otherwise(a["end"]).alias("end"),
            )

        return F.aggregate(
            F.slice(m["marks"], s + 1, m["t"]["reach"]), zero, step, lambda a: F.struct(a["dice"].alias("dice"), (-s).alias("back"), a["end"].alias("n"))
        )

    def best_stretch(m: Column) -> Column:
        hits = F.transform(F.filter(m["marks"], lambda x: x["hit"]), lambda x: x["i"])
        starts = bound(hits, lambda h: F.filter(F.transform(h, lambda i, k: F.when(F.get(h, k + m["t"]["need"] - 1) < i + m["t"]["reach"], i)), lambda i: i.isNotNull()))
        return F.array_max(F.transform(starts, lambda s: ends(m, s)))

    best_of = F.transform(F.transform(marked, lambda m: F.struct(m["t"]["licence"].alias("licence"), best_stretch(m).alias("b"))), lambda x: F.struct(
        x["b"]["dice"].alias("dice"), x["licence"].alias("licence"), F.concat_ws(" ", F.slice(w, 1 - x["b"]["back"], x["b"]["n"] + 1)).alias("unit")
    ))
    added = F.filter(
        F.col(stretches), lambda x: (x["dice"] >= least) & ~F.exists(F.col(found), lambda u: (u["licence"] == x["licence"]) & (u["dice"] >= x["dice"]))
    )
    none = "array<struct<dice:double,licence:string,unit:string>>"
    best = F.get(F.array_sort(F.col(found), lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).otherwise(0)), 0)
    kept = [c for c in docs.columns if c not in ("licence", "dice", "licence_units")]
    return (
        docs.withColumn(words, F.split(normalise(body), " "))
        .withColumn(grams, F.when(gate, cells))
        .withColumn(stream, F.when(F.col(grams).isNotNull(), linked))
        .withColumn(found, F.coalesce(scored, F.array().cast(none)))
        .withColumn(stretches, F.coalesce(best_of, F.array().cast(none)))
        .withColumn(found, F.concat(F.col(found), added))
        .select(*kept, best["licence"].alias("licence"), best["dice"].alias("dice"), F.col(found).alias("licence_units"))
    )
