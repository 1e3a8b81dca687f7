"""Column expressions shared by the operators. Time is whole microseconds everywhere: exact, and the same in any partitioning."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def null_if_nan(c: Column) -> Column:
    """Missing measurements are NULL: Spark's medians and averages skip NULL but not NaN."""
    return F.when(~F.isnan(c), c)


def kept(d: DataFrame) -> DataFrame:
    """``d`` written to the checkpoint folder, which driver and executors share, for plans that read it several times: nothing is held in
    executors' memory and nothing is worked out twice, also when executors are lost. A local session without such a folder gets one.
    """
    sc = d.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir") or d.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="dipfold-"))
    return d.checkpoint()


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def days_to_us(c: Column) -> Column:
    return F.rint(c * DAY_US).cast("long")


def phase(t: Column, period: Column, epoch: Column) -> Column:
    """Signed distance to the nearest predicted event, in [-P/2, P/2)."""
    half = F.floor(period / 2).cast("long")
    return F.pmod(t - epoch + half, period) - half


def cycle(t: Column, period: Column, epoch: Column) -> Column:
    """Number of the nearest event, ties to even."""
    return F.rint((t - epoch) / period).cast("long")


def near_event(ph: Column, duration: Column) -> Column:
    """Within one and a half durations of an event."""
    return 2 * F.abs(ph) < 3 * duration


def close_to(c: Column, value: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.coalesce(F.abs(c - value) <= atol + rtol * abs(value), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b)


def tenths_text(x: Column, signed: bool = False) -> Column:
    """A number with one digit, as C prints it: the double's exact value counts, exact ties go to the even digit (Java rounds up, and rounds the
    shortest decimals). NULL stays NULL. From 1e18 on, digits are Java's.
    """
    x = x.cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole  # exact
    tenths = 8 * part + 2 * part
    lost = 2 * part - (tenths - 8 * part)  # ten times the part is exactly tenths + lost
    tie = (tenths - F.floor(tenths) == 0.5) & (lost != 0)
    digit = F.when(tie, F.floor(tenths) + (lost > 0).cast("int")).otherwise(F.rint(tenths).cast("long"))
    text = F.concat((whole + F.floor(digit / 10)).cast("string"), F.lit("."), (digit % 10).cast("string"))
    text = F.when(F.isnan(x), "nan").when(size == float("inf"), "inf").when(size >= 1e18, F.format_string("%.1f", size)).otherwise(text)
    return F.when(x.isNotNull(), F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise("+" if signed else ""), text))


def share_text(part: Column, whole: Column) -> Column:
    """``x/n (p%)``, without a percentage when n is zero."""
    plain = F.format_string("%d/%d", part, whole)
    return F.when(whole == 0, plain).otherwise(F.concat(plain, F.lit(" ("), tenths_text(part * 100.0 / F.nullif(whole, F.lit(0))), F.lit("%)")))


def percent_text(share: Column, signed: bool = False) -> Column:
    """A share as a percentage with one digit, with its sign if asked."""
    return F.concat(tenths_text(share * 100, signed), F.lit("%"))


def thousands_text(n: Column) -> Column:
    return F.format_number(n, 0)


def stamped(d: DataFrame, name: str = "created_at") -> DataFrame:
    """Adds the time of the query, the default of a new row's stamp."""
    return d.withColumn(name, F.current_timestamp())


def hash_unit(key: Column, seed: int | str) -> Column:
    """A number below 2**32 from an md5 prefix: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def in_bands(c: Column, edges: list[float], closed: str = "right") -> Column:
    """Index of the band of ``edges`` that holds the value; NULL outside.

    ``right``: bands (a, b]. ``left``: bands [a, b) with the last closed on both sides.
    """
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        a, b = edges[k], edges[k + 1]
        last = k == len(edges) - 2
        inside = (c > a) & (c <= b) if closed == "right" else (c >= a) & ((c <= b) if last else (c < b))
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out
