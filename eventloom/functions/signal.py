"""Column expressions on signals: arrays of samples, or one sample a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pA band that samples must lie in; both ends are excluded.
BAND = (30.0, 200.0)
#: Samples this many standard deviations away, or more, are dropped.
SIGMAS = 3.0


def calibrated(raw: Column, offset: Column, scale: Column) -> Column:
    """Raw samples in pA: (raw + offset) * scale."""
    return F.transform(raw, lambda x: (x.cast("double") + offset) * scale)


def calibrated_by_range(raw: Column, digitisation: Column, offset: Column, range_: Column) -> Column:
    """Raw samples in pA, for formats that give the range and the number of steps."""
    return calibrated(raw, offset, range_ / digitisation)


def in_band(samples: Column, low: float = BAND[0], high: float = BAND[1]) -> Column:
    """The samples strictly inside the band, in order."""
    return F.filter(samples, lambda x: (x > low) & (x < high))


def mean(samples: Column) -> Column:
    return F.try_divide(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x), F.size(samples).cast("double"))


def z_scored(samples: Column) -> Column:
    """Samples less their mean, over their population standard deviation; null if that is 0 or there are none."""

    def with_mean(m: Column) -> Column:
        spread = F.sqrt(F.try_divide(F.aggregate(samples, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(samples).cast("double")))
        return F.transform(F.array(spread), lambda s: F.when(s > 0, F.transform(samples, lambda x: (x - m) / s)))[0]

    return F.transform(F.array(mean(samples)), with_mean)[0]


def within_sigmas(samples: Column, sigmas: float = SIGMAS) -> Column:
    """The z-scores strictly inside +-sigmas, in order; indices close up."""
    return F.filter(samples, lambda z: (z > -sigmas) & (z < sigmas))


def log_emission(x: Column, mean_: Column, variance: Column) -> Column:
    """The log density of a normal distribution."""
    import math

    return -0.5 * (math.log(2 * math.pi) + F.ln(variance)) - F.pow(x - mean_, 2) / (2 * variance)


def log_or_none(p: Column) -> Column:
    """ln p, minus infinity for 0 or less."""
    return F.when(p > 0, F.ln(p)).otherwise(F.lit(float("-inf")))


def middle_mean(segment: Column) -> Column:
    """The mean of the values within one quartile distance of the quartiles, which are taken by index; 0 if there are none."""
    n = F.size(segment)

    def of_sorted(s: Column) -> Column:
        q1, q3 = F.get(s, F.floor(n / 4).cast("int")), F.get(s, F.floor(3 * n / 4).cast("int"))
        return F.filter(s, lambda x: (x >= q1 - (q3 - q1)) & (x <= q3 + (q3 - q1)))

    return F.coalesce(mean(F.transform(F.array(F.sort_array(segment)), of_sorted)[0]), F.lit(0.0))


def decoded_kmer(value: Column, k: int) -> Column:
    """A number as a k-mer: two bits a base, A C G T."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def extended(start: Column, end: Column, query_start: Column, query_end: Column, query_len: Column, ref_len: Column, forward: Column, factor: float) -> tuple[Column, Column]:
    """The reference interval that an alignment would have if the query's ends were aligned too, stretched by a factor."""
    head, tail = (query_start * factor).cast("int"), ((query_len - query_end) * factor).cast("int")
    before, after = F.when(forward, head).otherwise(tail), F.when(forward, tail).otherwise(head)
    return F.greatest(F.lit(1), start - before), F.least(ref_len, end + after)


def tag(tags: Column, name: str) -> Column:
    """The value of the first tag that starts with the name, such as mt:f:."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(name)), F.lit(0)), len(name) + 1, 1 << 30)
