"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def softplus(x) -> Column:
    x = _c(x)
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x, bound: float = 60.0) -> Column:
    x = F.greatest(F.least(_c(x), F.lit(bound)), F.lit(-bound))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p, eps: float = 1e-9) -> Column:
    p = F.greatest(F.least(_c(p), F.lit(1.0 - eps)), F.lit(eps))
    return F.log(p / (F.lit(1.0) - p))


def logsumexp2(a, b) -> Column:
    a, b = _c(a), _c(b)
    m = F.greatest(a, b)
    return m + F.log(F.exp(a - m) + F.exp(b - m))


def poisson_logpmf(k, rate, log_factorial, floor: float = 1e-12) -> Column:
    """``log P(k | rate)``; ``log_factorial`` is a column, see :func:`log_factorials`."""
    rate = F.greatest(_c(rate), F.lit(floor))
    return _c(k) * F.log(rate) - rate - _c(log_factorial)


def log_factorials(counts: DataFrame, k: str = "k") -> DataFrame:
    """Each distinct count with its log factorial, as a running sum of logs."""
    return counts.select(k).distinct().withColumn(
        "log_factorial",
        F.expr(f"aggregate(sequence(1, greatest({k}, 1)), 0D, (a, i) -> a + ln(i))"),
    )


def decay(beta, dt) -> Column:
    return F.exp(-_c(beta) * _c(dt))


def decay_integral(beta, dt) -> Column:
    return -F.expm1(-_c(beta) * _c(dt)) / _c(beta)


def ctmc_transition(eta_on, eta_off, delta) -> tuple[Column, Column, Column, Column]:
    """``p00, p01, p10, p11`` of the two-state chain over a step of ``delta``."""
    on, off = _c(eta_on), _c(eta_off)
    s = on + off
    e = F.exp(-s * _c(delta))
    p00 = (off + on * e) / s
    p11 = (on + off * e) / s
    return p00, F.lit(1.0) - p00, F.lit(1.0) - p11, p11


def combine_scores(a, b, mode: str = "geometric") -> Column:
    a, b = _c(a), _c(b)
    if mode == "geometric":
        return F.sqrt(a * b)
    if mode == "max":
        return F.greatest(a, b)
    if mode == "sum":
        return a + b
    raise ValueError(f"unknown combination mode: {mode}")


def max_normalise(df: DataFrame, keys: Sequence[str], cols: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """Divide columns by their group maximum; the maxima come from one small aggregate."""
    tops = df.groupBy(*keys).agg(*[F.max(c).alias(f"__max_{c}") for c in cols])
    out = df.join(tops, list(keys))
    return out.select(
        *[
            (F.col(c) / F.greatest(F.col(f"__max_{c}"), F.lit(floor))).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def row_stochastic(df: DataFrame, row_keys: Sequence[str], value: str, eps: float = 1e-9) -> DataFrame:
    """Floor a long matrix at ``eps`` and scale each row to one."""
    floored = df.withColumn(value, F.greatest(F.col(value), F.lit(eps)))
    total = F.greatest(F.sum(value).over(Window.partitionBy(*row_keys)), F.lit(eps))
    return floored.withColumn(value, F.col(value) / total)


def uniform_draw(seed, label, *ids) -> Column:
    """A reproducible draw in [0, 1): the first 52 bits of an MD5 over ``seed|label|ids``."""
    text = F.concat_ws("|", *[_c(x).cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in (seed, label)],
                       *[_c(i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))



def to_days(ts, origin) -> Column:
    return (F.unix_micros(_c(ts).cast("timestamp")) - F.unix_micros(_c(origin).cast("timestamp"))) / F.lit(8.64e10)


def json_int_array(text) -> Column:
    """JSON array text to an integer array; bad text gives null."""
    return F.from_json(_c(text).cast("string"), "array<int>")
