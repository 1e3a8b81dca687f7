"""Masked Savitzky-Golay detrending in column expressions.

A quadratic that is fitted to the odd number of points around each point follows from three sums over them: of the flux, of offset x flux and
of offset squared x flux. Curves are cut into blocks of one window's length, each with running sums of its own; a window lies in at most two
blocks, so its sums are the rest of one block and the beginning of the next. The work for a point does not depend on the window, and no
sum is longer than a window, so nothing is lost to cancellation.

Everything stays partitioned by candidate. A segment (a piece of a curve without a gap) is gathered once, as an array, for the lookups at the
window's two ends; it is part of one star's curve, of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.operators import timeseries as T

GAP_FACTOR = 5.0
LEAST_WINDOW = 5


def _shares(least: float) -> Column:
    """The mask of the candidate's rung, as :func:`timeseries.detrend_rung` has it; NULL if there is none."""
    one = Window.partitionBy(*T.KEY)
    full, second, first = F.col("in_secondary") | F.col("in_sibling"), F.col("in_secondary"), F.col("in_primary")
    enough = lambda c: F.avg((~c).cast("int")).over(one) >= least
    return F.when(enough(full), full).when(enough(second), second).when(enough(first), first)


def _filled() -> Column:
    """The flux of points that are seen; between them a straight line by time, beyond them the nearest."""
    v, before, after = F.col("_v"), F.col("_before"), F.col("_after")
    step = F.coalesce(X.ratio(after["v"] - before["v"], after["t"] - before["t"]), F.lit(0.0))
    return F.when(F.col("_seen"), v).when(before.isNull(), after["v"]).when(after.isNull(), before["v"]).otherwise(step * (F.col("t_us") - before["t"]) + before["v"])


def flattened(d: DataFrame, gap_factor: float = GAP_FACTOR, least: float = T.MIN_SHARE) -> DataFrame:
    """Adds ``flat`` (NULL where it cannot be told) and ``status`` to the masked curve of :func:`timeseries.masked`.

    Masked points take no part in the fit; a segment ends where a gap is longer than ``gap_factor`` times the median gap. Near a segment's ends
    the quadratic of its first and last whole window is read off; a segment shorter than the window has its median for a trend. ``status`` is
    ``none`` where no rung leaves enough points (the curve is left as it is), ``nodata`` where nothing can be told, else empty.
    """
    d = d.drop("siblings")
    names = [c for c in d.columns if c not in T.KEY]
    one = Window.partitionBy(*T.KEY)
    by_time = one.orderBy("t_us")
    d = d.withColumn("_gap", F.col("t_us") - F.lag("t_us").over(by_time)).withColumn("_cadence", F.median("_gap").over(one)).withColumn("_mask", _shares(least))
    window = F.when(F.col("_cadence") > 0, T.window_points(F.col("duration_us"), F.col("_cadence") / 60e6)).cast("long")
    d = d.withColumn("_w", window).withColumn("_v", F.col("flux").cast("double"))
    d = d.withColumn("_segment", F.sum(F.when(F.col("_gap") > gap_factor * F.col("_cadence"), 1).otherwise(0)).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_seen", X.finite(F.col("_v")) & ~F.coalesce("_mask", F.lit(False)))
    part = Window.partitionBy(*T.KEY, "_segment")
    point = F.when(F.col("_seen"), F.struct(F.col("t_us").alias("t"), F.col("_v").alias("v")))
    so_far = (Window.unboundedPreceding, 0)
    d = d.withColumns({
        "_before": F.last(point, ignorenulls=True).over(part.orderBy("t_us").rowsBetween(*so_far)),
        "_after": F.last(point, ignorenulls=True).over(part.orderBy(F.desc("t_us")).rowsBetween(*so_far)),
        "_i": (F.row_number().over(part.orderBy("t_us")) - 1).cast("long"),
    })
    w = F.coalesce("_w", F.lit(LEAST_WINDOW))
    d = d.withColumn("_y", _filled()).withColumn("_level", F.median("_y").over(part)).withColumn("_block", F.floor(F.col("_i") / w)).withColumn("_r", F.col("_i") % w)
    block = Window.partitionBy(*T.KEY, "_segment", "_block")
    running = block.orderBy("_i").rowsBetween(*so_far)
    powers = [F.col("_y"), F.col("_r") * F.col("_y"), F.col("_r") * F.col("_r") * F.col("_y")]
    d = d.withColumns({f"_p{k}": F.sum(y).over(running) for k, y in enumerate(powers)} | {f"_s{k}": F.sum(y).over(block) for k, y in enumerate(powers)})
    sums = lambda c: F.struct(*(F.col(f"_{c}{k}").alias(f"m{k}") for k in range(3)))
    row = F.struct(F.col("_i").alias("i"), F.struct(*names, "_v", "_mask", "_level").alias("row"), sums("p").alias("p"), sums("s").alias("s"))
    cells = d.groupBy(*T.KEY, "_segment", "_w").agg(F.sort_array(F.collect_list(row)).alias("cells"))
    n, h, w = F.size("cells"), F.floor((F.coalesce("_w", F.lit(LEAST_WINDOW)) - 1) / 2), F.coalesce("_w", F.lit(LEAST_WINDOW))
    middle = lambda i: F.least(F.greatest(i, h), n - 1 - h)
    at = lambda k: F.get("cells", k.cast("int"))

    def ends(x: Column) -> Column:
        c = middle(x["i"])
        return F.struct(x["row"].alias("row"), x["i"].alias("i"), c.alias("c"), at(c - h - 1)["p"].alias("before"), at(c - h)["s"].alias("first"), at(c + h)["p"].alias("upto"))

    long = cells.select(*T.KEY, n.cast("long").alias("n"), h.cast("long").alias("h"), w.alias("w"), "_w", F.inline(F.transform("cells", ends)))
    # step by step, so that what is used several times is worked out once
    low, w, col = F.col("low"), F.col("w"), F.col
    d = long.withColumn("low", col("c") - col("h"))
    d = d.withColumns({"whole": low % w == 0, "start": F.floor(low / w) * w - col("c")})  # whole: the window is a block
    rest = {f"a{k}": col(f"first.m{k}") - F.when(col("whole"), F.lit(0.0)).otherwise(col(f"before.m{k}")) for k in range(3)}
    begun = {f"b{k}": F.when(col("whole"), F.lit(0.0)).otherwise(col(f"upto.m{k}")) for k in range(3)}
    d = d.withColumns(rest | begun | {"x": col("start").cast("double"), "y": (col("start") + w).cast("double")})
    d = d.withColumns({
        "m0": col("a0") + col("b0"), "m1": col("a1") + col("x") * col("a0") + col("b1") + col("y") * col("b0"),
        "m2": col("a2") + 2 * col("x") * col("a1") + col("x") * col("x") * col("a0") + col("b2") + 2 * col("y") * col("b1") + col("y") * col("y") * col("b0"),
        "s2": (col("h") * (col("h") + 1) * w).cast("double") / 3, "u": (col("i") - col("c")).cast("double"),
    })
    # the least-squares quadratic over offsets -h .. h, w points, at the offset u
    d = d.withColumn("s4", col("s2") * (3 * col("h") * col("h") + 3 * col("h") - 1) / 5)
    d = d.withColumn("curved", (w * col("m2") - col("s2") * col("m0")) / (w * col("s4") - col("s2") * col("s2")))
    fit = (col("m0") - col("curved") * col("s2")) / w + col("u") * col("m1") / col("s2") + col("u") * col("u") * col("curved")
    d = d.withColumn("level", F.when(col("n") < w, col("row._level")).otherwise(fit))
    d = d.withColumn("flat", F.when(col("row._mask").isNull(), col("row._v")).when(col("_w").isNotNull(), X.ratio(col("row._v"), col("level"))))
    out = d.select(*T.KEY, *(col(f"row.{c}").alias(c) for c in names), F.when(X.finite(col("flat")), col("flat")).alias("flat"), col("row._mask").isNull().alias("_none"))
    status = F.when(F.col("_none"), "none").when(F.max(F.col("flat").isNotNull()).over(one), "").otherwise("nodata")
    return out.withColumn("status", status).drop("_none")
