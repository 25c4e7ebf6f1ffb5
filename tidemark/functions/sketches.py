"""Quantiles from mergeable KLL sketches: partial in every task, merged by the shuffle, of a size that doesn't grow with the rows.

A quantile is the least value that a share q of all values doesn't exceed. A sketch of detail k keeps every value while there
are k of them or fewer, and is exact then; beyond that the rank of an answer is off by some 1.7 * k ** -0.9 of all rows at
most, with 99 % certainty (k = 8192: 0.05 %). Nulls are not counted; a sketch of nothing has null quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For many sketches in one row, about 200 kB each when full; and for few.
DETAIL, FINE = 8192, 32768


def sketch(x: Column | str, detail: int = DETAIL) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.kll_sketch_agg_double(F.nanvl(x.cast("double"), F.lit(None).cast("double")), detail)


def quantile(made: Column, q: float) -> Column:
    return F.when(F.kll_sketch_get_n_double(made) > 0, F.kll_sketch_get_quantile_double(made, F.lit(float(q))))


def quantiles(made: Column, at: list[float]) -> Column:
    return F.when(F.kll_sketch_get_n_double(made) > 0, F.kll_sketch_get_quantile_double(made, F.array(*[F.lit(float(q)) for q in at])))
