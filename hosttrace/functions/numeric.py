"""Numeric and time column functions."""

from pyspark.sql import functions as F

# Accepted time formats, first match wins.
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
]


def parse_time(c):
    """Text to timestamp (UTC session) over the known formats; NULL when none fits."""
    text = F.replace(F.trim(c), F.lit("Z"), F.lit(""))
    text = F.regexp_replace(text, r"(\.\d{6})\d+$", "$1")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS], F.try_to_timestamp(text))


def epoch_seconds(ts):
    return F.unix_micros(ts) / F.lit(1e6)


def number_or(c, default=0.0):
    return F.coalesce(c.try_cast("double"), F.lit(default))


def percent(part, whole):
    """``part`` of ``whole`` in percent, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def ratio(part, whole):
    """part / whole with 0 for a zero denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson(successes, n, z=1.96):
    """Wilson score interval as (low, high); NULL for n = 0."""
    k, n = successes.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return (centre - half) / d, (centre + half) / d
