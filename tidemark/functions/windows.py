"""Column builders over trailing windows of one symbol, with null and minimum-observation rules.

Missing is NULL, never NaN. `over(n, shift)` ends `shift` rows before the current one, so a feature that may only
see complete bars is built with shift=1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-12


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def over(n: int, shift: int = 0) -> WindowSpec:
    return series().rowsBetween(-(n - 1) - shift, -shift)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def observed(least: int, x: Column, w: WindowSpec, value: Column) -> Column:
    """value where at least `least` rows of the window have x."""
    return F.when(F.count(x).over(w) >= least, value)


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null; greatest() alone would turn it into the bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def change(x: Column, k: int = 1) -> Column:
    return ratio(x, lag(x, k)) - 1


def mean(x: Column, n: int, least: int | None = None, shift: int = 0) -> Column:
    w = over(n, shift)
    return observed(max(2, n // 2) if least is None else least, x, w, F.avg(x).over(w))


def deviation(x: Column, n: int, least: int | None = None, shift: int = 0) -> Column:
    """Population standard deviation."""
    w = over(n, shift)
    return observed(max(3, n // 2) if least is None else least, x, w, F.stddev_pop(x).over(w))


def lowest(x: Column, n: int, least: int) -> Column:
    return observed(least, x, over(n), F.min(x).over(over(n)))


def highest(x: Column, n: int, least: int) -> Column:
    return observed(least, x, over(n), F.max(x).over(over(n)))


def zscore(x: Column, n: int) -> Column:
    w = over(n)
    sd = F.stddev_pop(x).over(w)
    return F.when((F.count(x).over(w) >= max(5, n // 2)) & (sd > EPS), (x - F.avg(x).over(w)) / sd)


def moving_corr(x: Column, y: Column, n: int, least: int | None = None) -> Column:
    """Pearson correlation, null where either side is constant (corr() would divide by zero)."""
    both = x.isNotNull() & y.isNotNull()
    a, b, w = F.when(both, x), F.when(both, y), over(n)
    sd = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return clip(observed(n // 2 if least is None else least, a, w, F.when(sd > EPS, F.covar_pop(a, b).over(w) / sd)), -1.0, 1.0)


def moving_beta(x: Column, y: Column, n: int) -> Column:
    """Sample covariance over population variance: the mix the results are defined by."""
    both = x.isNotNull() & y.isNotNull()
    a, b, w = F.when(both, x), F.when(both, y), over(n)
    return observed(n // 2, a, w, ratio(F.covar_samp(a, b).over(w), F.var_pop(b).over(w)))


def skew_corrected(x: Column, n: int) -> Column:
    """Bias-corrected sample skewness (skewness() is the population form)."""
    w = over(n)
    c = F.count(x).over(w)
    return F.when((c >= max(3, 10 * n // 21)) & (F.var_pop(x).over(w) > EPS), F.sqrt(c * (c - 1)) / (c - 2) * F.skewness(x).over(w))


def kurt_corrected(x: Column, n: int) -> Column:
    w = over(n)
    c = F.count(x).over(w)
    return F.when(
        (c >= max(4, 10 * n // 21)) & (F.var_pop(x).over(w) > EPS), (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.kurtosis(x).over(w) + 6)
    )


def ffill(x: Column, limit: int | None = None) -> Column:
    w = so_far() if limit is None else series().rowsBetween(-limit, 0)
    return F.last(x, ignorenulls=True).over(w)


def bfill(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))
