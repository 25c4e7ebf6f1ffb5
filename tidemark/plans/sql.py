"""Small pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

BARS = """bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem)
  GROUP BY 1, 2)"""
CONTEXT = """ctx AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"""
SERIES = "(PARTITION BY symbol ORDER BY date)"


def win(n: int, shift: int = 0) -> str:
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {SERIES}"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END)"


def change(x: str, k: int = 1) -> str:
    return f"({ratio(x, lag(x, k))} - 1)"


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, {x})) END)"


def rolled(f: str, x: str, n: int, least: int, shift: int = 0) -> str:
    """f(x) over the last n rows, where at least `least` of them have x."""
    w = win(n, shift)
    return f"(CASE WHEN count({x}) OVER {w} >= {least} THEN {f}({x}) OVER {w} END)"


def mean(x: str, n: int, least: int | None = None) -> str:
    return rolled("avg", x, n, max(2, n // 2) if least is None else least)


def deviation(x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    return rolled("stddev_pop", x, n, max(3, n // 2) if least is None else least, shift)


def zscore(x: str, n: int) -> str:
    w = win(n)
    return f"(CASE WHEN count({x}) OVER {w} >= {max(5, n // 2)} AND stddev_pop({x}) OVER {w} > 1e-12 THEN ({x} - avg({x}) OVER {w}) / stddev_pop({x}) OVER {w} END)"


def pair_corr(x: str, y: str, n: int) -> str:
    w = win(n)
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    sd = f"(stddev_pop({a}) OVER {w} * stddev_pop({b}) OVER {w})"
    return clip(f"(CASE WHEN count({a}) OVER {w} >= {n // 2} AND {sd} > 1e-12 THEN covar_pop({a}, {b}) OVER {w} / {sd} END)", -1.0, 1.0)


def staged(*stages: dict[str, str], base: str = "bars", head: str = BARS) -> tuple[str, str]:
    """WITH-list and name of the last stage; each stage adds columns to the one before."""
    ctes, last = [head], base
    for k, columns in enumerate(stages):
        ctes.append(f"s{k} AS (SELECT *, " + ", ".join(f"{x} AS {name}" for name, x in columns.items()) + f" FROM {last})")
        last = f"s{k}"
    return "WITH " + ", ".join(ctes), last


def select(keys: list[str], values: list[str], made: tuple[str, str], digits: int = 6) -> str:
    shown = ", ".join([*keys, *[f"round(CAST({v} AS DOUBLE), {digits}) + 0.0 AS {v}" for v in values]])
    return f"{made[0]} SELECT {shown} FROM {made[1]}"


def smoothed(made: tuple[str, str], specs: dict[str, tuple[str, float, int]], name: str) -> tuple[str, str]:
    """made plus recursively smoothed columns: out -> (input, alpha, least), as a recursive query over row numbers."""
    keys = list(specs)
    xs = ", ".join(f"CAST({x} AS DOUBLE) AS x{k}" for k, (x, _, _) in enumerate(specs.values()))
    start = ", ".join(f"x{k} AS y{k}, CAST(1 AS DOUBLE) AS w{k}" for k in range(len(keys)))
    step = []
    for k, (_, a, _) in enumerate(specs.values()):
        old = f"(r.w{k} * {1 - a!r})"
        step.append(f"CASE WHEN b.x{k} IS NULL THEN r.y{k} WHEN r.y{k} IS NULL THEN b.x{k} ELSE ({old} * r.y{k} + {a!r} * b.x{k}) / ({old} + {a!r}) END")
        step.append(f"CASE WHEN b.x{k} IS NULL AND r.y{k} IS NOT NULL THEN {old} ELSE CAST(1 AS DOUBLE) END")
    shown = ", ".join(f"CASE WHEN count({x}) OVER (PARTITION BY s.symbol ORDER BY s.date) >= {least} THEN y{k} END AS {out}" for k, (out, (x, _, least)) in enumerate(specs.items()))
    head = made[0].replace("WITH ", "WITH RECURSIVE ", 1) if "WITH RECURSIVE" not in made[0] else made[0]
    return (
        f"{head}, {name}b AS MATERIALIZED (SELECT symbol, date, row_number() OVER {SERIES} AS rn, {xs} FROM {made[1]}), "
        f"{name}r AS (SELECT symbol, rn, {start} FROM {name}b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {', '.join(step)} FROM {name}r r JOIN {name}b b ON b.symbol = r.symbol AND b.rn = r.rn + 1), "
        f"{name} AS (SELECT s.*, {shown} FROM {made[1]} s JOIN {name}b USING (symbol, date) JOIN {name}r USING (symbol, rn))",
        name,
    )


def then(made: tuple[str, str], columns: dict[str, str], name: str) -> tuple[str, str]:
    """made plus columns."""
    return f"{made[0]}, {name} AS (SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + f" FROM {made[1]})", name
