"""Grouped splits, metrics and boosted trees."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dipfold.functions import expressions as X
from dipfold.operators import boosting, relational, stats

#: Thresholds, names of features, and columns that must not be features.
THRESHOLDS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
FEATURES = ("depth", "width", "asymmetry", "snr", "odd_even_diff", "secondary_depth")
#: Catalogue columns that give the label away or are not measurements; they are never features.
LEAKAGE = ("koi_depth_ppm", "koi_duration_hours", "koi_period_days", "koi_num_transits")
FAR = 1e12
GROUP_ROWS = 10_000


def cuts(groups: DataFrame, group: str, seeds: dict[str, int], share: float) -> dict[str, tuple | None]:
    """For each seed the last ``(hash, group)`` of the share of ``groups`` (distinct values) that is held out: exactly ``ceil(share n)`` of them.

    Groups are counted by the upper twelve bits of their hash, 4,096 numbers a seed; only those of the one cell in which the share is reached are put in order.
    """
    seeded = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), X.hash_unit(F.col(group), seed).alias("h")) for name, seed in seeds.items()))).alias("x")
    hashed = X.kept(groups.select(group, seeded).select(group, "x.name", "x.h").withColumn("cell", F.shiftright("h", 20)))
    cells: dict[str, list[tuple[int, int]]] = {name: [] for name in seeds}
    for r in hashed.groupBy("name", "cell").agg(F.count("*").alias("n")).collect():  # at most 4,096 numbers a seed
        cells[r.name].append((r.cell, r.n))
    out: dict[str, tuple | None] = {}
    at = []
    for name, own in cells.items():
        left = math.ceil(Decimal(str(share)) * sum(n for _, n in own))
        out[name] = None
        for cell, n in sorted(own):
            if 0 < left <= n:
                at.append((name, cell, left))
            left -= n
    if at:
        inside = hashed.join(F.broadcast(groups.sparkSession.createDataFrame(at, "name string, cell long, k int")), ["name", "cell"])  # a row a seed
        place = F.row_number().over(Window.partitionBy("name").orderBy("h", group))
        for r in inside.withColumn("place", place).where("place = k").collect():
            out[r["name"]] = (r.h, r[group])
    return out


def held_out(d: DataFrame, group: str, seeds: dict[str, int], share: float = 0.2) -> dict[str, Column]:
    """For each seed whether a row's whole group is held out: the ``ceil(share n)`` groups with the smallest hashes, so no group is on both sides."""
    out = {}
    for name, cut in cuts(d.select(group).distinct(), group, seeds, share).items():
        h, g = X.hash_unit(F.col(group), seeds[name]), F.col(group)
        if cut is None:
            out[name] = F.lit(False)
        else:
            tie = g.isNull() if cut[1] is None else g.isNull() | (g <= F.lit(cut[1]))
            out[name] = (h < cut[0]) | ((h == cut[0]) & tie)
    return out


def split(d: DataFrame, group: str, seed: int = 42, share: float = 0.2, inner_seed: int = 7, inner_share: float = 0.25) -> DataFrame:
    """Adds ``part``: test (a share of the groups), validation (a share of what is left), or train."""
    test = held_out(d, group, {"test": seed}, share)["test"]
    inner = held_out(d.where(~test), group, {"validation": inner_seed}, inner_share)["validation"]
    return d.withColumn("part", F.when(test, "test").when(inner, "validation").otherwise("train"))


def fold_of(group: Column, folds: int = 5, seed: int = 0) -> Column:
    return F.pmod(X.hash_unit(group, seed), F.lit(folds)).cast("int")


def confusion(d: DataFrame, score: str, label: str, threshold: Column, by: list[str]) -> DataFrame:
    """Counts and what follows from them; shares are NULL where there is nothing to divide by."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    g = d.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.withColumns({
        "precision": X.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": X.ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "accuracy": X.ratio(F.col("tp") + F.col("tn"), n), "queue_cut": X.ratio(F.col("tn") + F.col("fn"), n),
        "lost": X.ratio(F.col("fn"), F.col("tp") + F.col("fn")),
    })


def threshold_sweep(d: DataFrame, score: str, label: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Confusion at each threshold. Rows are first counted by how many thresholds they pass, so nothing is multiplied."""
    levels = sorted(thresholds)
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in levels), F.lit(0))
    per = d.groupBy(passed.alias("level")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    cols = []
    for k in range(len(levels)):
        over = F.col("level") > k
        for name, cond, c in (("tp", over, "pos"), ("fp", over, "neg"), ("fn", ~over, "pos"), ("tn", ~over, "neg")):
            cols.append(F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long").alias(f"{name}{k}"))
    one = per.agg(*cols)
    stack = ", ".join(f"{t}D, tp{k}, fp{k}, fn{k}, tn{k}" for k, t in enumerate(levels))
    g = one.select(F.expr(f"stack({len(levels)}, {stack}) AS (threshold, tp, fp, fn, tn)"))
    return g.withColumns({"precision": X.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": X.ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def score_steps(d: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score: what ranking metrics need, after a map-side sum."""
    return d.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(d: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve as the share of rightly ordered pairs, ties half; NULL with one class only."""
    s = stats.sums_below(score_steps(d, score, label, by), score, by, ["neg"])
    won = F.sum(F.col("pos") * (2 * F.col("below_neg") + F.col("neg")))
    return s.groupBy(*by).agg(X.ratio(won, 2 * F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def average_precision(d: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Sum over thresholds of the gain in recall times the precision."""
    s = stats.sums_below(score_steps(d, score, label, by), score, by, ["pos", "neg"])
    tp = F.col("all_pos") - F.col("below_pos")
    taken = tp + F.col("all_neg") - F.col("below_neg")
    return s.groupBy(*by).agg(X.ratio(F.sum(F.col("pos") * tp / taken), F.sum("pos")).alias("average_precision"))


def paired(metrics: DataFrame, a: str, b: str, config: str, seed: str, value: str) -> DataFrame:
    """Paired differences of two configurations over seeds: mean, population deviation, t, wins, and whether |t| > 2."""
    p = metrics.where(F.col(config).isin(a, b)).groupBy(seed).agg(
        (F.max(F.when(F.col(config) == a, F.col(value))) - F.max(F.when(F.col(config) == b, F.col(value)))).alias("d")
    )
    g = p.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.count("d").alias("n"), F.count_if(F.col("d") > 0).alias("wins"))
    return g.withColumn("t", X.ratio(F.col("mean"), F.col("sd") / F.sqrt("n"))).withColumn("real", F.abs("t") > 2)


def two_sided(d: DataFrame, features: list[str]) -> DataFrame:
    """Each feature twice, missing values far below in one copy and far above in the other, so a tree can send them either way."""
    from pyspark.ml.feature import VectorAssembler

    cols = {f"{f}_{s}": F.coalesce(F.col(f).cast("double"), F.lit(v)) for f in features for s, v in (("lo", -FAR), ("hi", FAR))}
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(d.withColumns(cols)).drop(*cols)


def boosted(train: DataFrame, features: list[str], label: str, rounds: int = 100, step: float = 0.1, depth: int = 5, least: int = 20, seed: int = 0):
    """Boosted trees on :func:`two_sided` features; a fitted Spark model."""
    from pyspark.ml.classification import GBTClassifier

    leaks = set(features) & set(LEAKAGE)
    if leaks:
        raise ValueError(f"not features: {sorted(leaks)}")
    gbt = GBTClassifier(labelCol="_y", featuresCol="features", maxIter=rounds, stepSize=step, maxDepth=depth, minInstancesPerNode=least, maxBins=255, seed=seed)
    rows = two_sided(train.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")), features)
    return gbt.fit(rows.select("features", "_y"))


def scored(model, d: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(two_sided(d, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model, features: list[str]) -> dict[str, float]:
    v = model.featureImportances.toArray()
    return {f: float(v[2 * k] + v[2 * k + 1]) for k, f in enumerate(features)}


def importance_table(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """Importances of a fitted model, largest first."""
    return spark.createDataFrame(list(importances(model, features).items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")


TRAIN, TEST, UNUSED = boosting.TRAIN, boosting.TEST, boosting.UNUSED
#: The grid of configurations that is searched, the default one first by its values below.
GRID = {"rate": (0.05, 0.1), "leaves": (15, 31), "least": (20, 40), "l2": (0.0, 1.0), "rounds": (100, 300)}
DEFAULTS = {"rate": 0.1, "leaves": 31, "least": 20, "l2": 0.0, "rounds": 100}


def configurations(grid: dict[str, tuple] = GRID) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def known(d: DataFrame, disposition: str = "disposition") -> DataFrame:
    """Rows with a verdict, as ``label`` 1 or 0; an open candidate is unknown, not negative."""
    return d.where(F.col(disposition).isin("CONFIRMED", "FALSE POSITIVE")).withColumn("label", (F.col(disposition) == "CONFIRMED").cast("int"))


def unknown(d: DataFrame, disposition: str = "disposition") -> DataFrame:
    return d.where(F.col(disposition) == "CANDIDATE")


def predicted(score: Column, threshold: float = 0.25) -> Column:
    return (score >= threshold).cast("int")


def experiments(d: DataFrame, key: str, label: str, features: list[str], runs: list[dict], parts: dict[str, Column], block_rows: int = boosting.BLOCK_ROWS) -> DataFrame:
    """Fit many models at once: ``(config, part, key, label, score)`` for the held-out rows of each run.

    A run is ``{"config", "part", "features", "params"}``: it is fitted on all rows whose part code is TRAIN and scores all those with TEST
    (:mod:`boosting`). Rows are never on the driver.
    """
    number = {p: k for k, p in enumerate(parts)}
    jobs = [{"columns": [features.index(f) for f in r["features"]], "part": number[r["part"]], "params": r["params"]} for r in runs]
    found = boosting.scores(d, key, label, features, jobs, list(parts.values()), block_rows)
    name = lambda field: F.element_at(F.array(*(F.lit(r[field]) for r in runs)), F.col("run") + 1).alias(field)
    return X.kept(found.select(name("config"), name("part"), "key", "label", "score"))


def metrics(predictions: DataFrame, threshold: float = 0.25, by: tuple[str, ...] = ("config", "part")) -> DataFrame:
    """Confusion, shares, AUC and average precision of each run; whatever cannot be told is NULL."""
    by = list(by)
    out = confusion(predictions, "score", "label", F.lit(threshold), by)
    out = out.join(roc_auc(predictions, "score", "label", by).select(*by, "auc"), by)
    return out.join(average_precision(predictions, "score", "label", by), by)


def measured(d: DataFrame, *columns: str) -> DataFrame:
    """What a fit needs of its rows, written down: splits, cuts and codes are made from it, and what lies before is worked out once."""
    return X.kept(d.select(*dict.fromkeys(columns)))


def ablation(d: DataFrame, key: str, group: str, label: str, families: dict[str, list[str]], seeds: list[int], params: dict | None = None) -> DataFrame:
    """Metrics of each feature family on each of the same grouped splits: ``config, part`` and what :func:`metrics` gives."""
    features = sorted({f for fs in families.values() for f in fs})
    d = measured(d, key, group, label, *features)
    parts = {s: F.when(test, TEST).otherwise(TRAIN) for s, test in held_out(d, group, {str(s): s for s in seeds}).items()}
    runs = [{"config": name, "part": str(s), "features": fs, "params": params or DEFAULTS} for name, fs in families.items() for s in seeds]
    return metrics(experiments(d, key, label, features, runs, parts))


def spread(results: DataFrame, columns: tuple[str, ...] = ("accuracy", "auc", "precision", "recall", "queue_cut", "lost")) -> DataFrame:
    """Mean and population deviation over the splits of each configuration."""
    return results.groupBy("config").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))


def inner_against_outer(d: DataFrame, key: str, group: str, label: str, features: list[str], params: dict | None = None) -> DataFrame:
    """Confusion on the test groups of a model fitted on all other rows, and of one fitted without the validation groups."""
    d = measured(d, key, group, label, *features)
    part = lambda unused: F.when(F.col("part") == "test", TEST).when(F.col("part") == unused, UNUSED).otherwise(TRAIN)
    runs = [{"config": c, "part": c, "features": features, "params": params or DEFAULTS} for c in ("outer", "inner")]
    return metrics(experiments(split(d, group), key, label, features, runs, {"outer": part("none"), "inner": part("validation")}), by=("config",))


def baselines(d: DataFrame, key: str, group: str, label: str, features: list[str], single: str, thresholds: tuple[float, ...] = (0.25, 0.4, 0.5, 0.6), seed: int = 42) -> DataFrame:
    """Accuracy on the held-out groups: the majority class, one feature alone and all features, at several thresholds."""
    d = measured(d, key, group, label, *features)
    test = {"t": F.when(held_out(d, group, {"t": seed})["t"], TEST).otherwise(TRAIN)}
    runs = [{"config": c, "part": "t", "features": fs, "params": DEFAULTS} for c, fs in (("single", [single]), ("all", features))]
    found = experiments(d, key, label, features, runs, test).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    g = confusion(found, "score", "label", F.col("threshold"), ["config", "threshold"]).select("config", "threshold", "accuracy")
    most = found.where("config = 'all'").groupBy("threshold").agg(F.avg("label").alias("p"))
    return g.unionByName(most.select(F.lit("majority").alias("config"), "threshold", F.greatest("p", 1 - F.col("p")).alias("accuracy")))


def fitted(d: DataFrame, key: str, label: str, features: list[str], params: dict | None = None, block_rows: int = boosting.BLOCK_ROWS) -> dict:
    """One model of all labelled rows of ``d``, with the names of its features: plain values that can be broadcast and stored."""
    leaks = set(features) & set(LEAKAGE)
    if leaks:
        raise ValueError(f"not features: {sorted(leaks)}")
    return {"features": features, "model": boosting.model(measured(d, key, label, *features), key, label, features, params or DEFAULTS, block_rows)}


def applied(bundle: dict, d: DataFrame, name: str = "score") -> DataFrame:
    """``d`` with the score of a model that :func:`fitted` gave, Arrow batch by Arrow batch where the rows lie."""
    sent = d.sparkSession.sparkContext.broadcast(bundle)  # a hundred trees of a few dozen nodes
    schema = T.StructType([*d.schema.fields, T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_pandas().to_numpy(float, na_value=np.nan) for f in sent.value["features"]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boosting.predict(sent.value["model"], x))], [*batch.schema.names, name])

    return d.mapInArrow(work, schema)


def save_bundle(spark: SparkSession, bundle: dict, path: str, threshold: float = 0.25) -> None:
    """Store a model: its nodes as a Parquet table, names of features, start, edges and threshold as one JSON line beside it."""
    nodes = [(t, k, *node) for t, tree in enumerate(bundle["model"]["trees"]) for k, node in enumerate(tree)]
    spark.createDataFrame(nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    head = {"features": bundle["features"], "threshold": threshold, "start": bundle["model"]["start"], "edges": bundle["model"]["edges"]}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


NODES = "tree int, node int, feature int, bin int, missing_left boolean, left int, right int, value double"


def load_bundle(spark: SparkSession, path: str) -> tuple[dict, float]:
    """What :func:`save_bundle` stored: the model and its threshold."""
    head = json.loads(spark.read.text(f"{path}/head").first().value)
    rows = spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect()  # a model's size
    trees: list[list[tuple]] = []
    for r in rows:
        trees += [[]] if r.node == 0 else []
        trees[-1].append(list(r)[2:])
    return {"features": head["features"], "model": {"start": head["start"], "edges": head["edges"], "trees": trees}}, head["threshold"]


def queue(bundle: dict, candidates: DataFrame, tie: str = "kepoi_name") -> DataFrame:
    """The review queue: candidates without an error, scored, each with its place from the highest score down."""
    ok = candidates.where(F.coalesce(F.col("error"), F.lit("")) == "") if "error" in candidates.columns else candidates
    return relational.placed(applied(bundle, ok), "score", tie)


def permutation_importance(bundle: dict, d: DataFrame, label: str, key: str, repeats: int = 30, threshold: float = 0.25) -> DataFrame:
    """Loss of accuracy when one feature is dealt anew among the rows: ``(feature, mean, std)``, largest first.

    Rows fall into random groups of about GROUP_ROWS and are dealt anew within their group: rows get a place in the group, and for each
    feature and repeat another one in another hash order, and meet by place. All features and repeats are one table and one scoring pass.
    """
    features = bundle["features"]
    groups = max(1, -(-d.count() // GROUP_ROWS))
    base = d.select(F.col(key).alias("_key"), F.col(label).alias("_y"), *(F.col(f).cast("double").alias(f) for f in features))
    base = base.withColumn("_g", F.pmod(X.hash_unit(F.col("_key"), "group"), F.lit(groups)))
    trials = F.explode(F.array(F.struct(F.lit("").alias("f"), F.lit(-1).alias("r")), *(F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f in features for r in range(repeats))))
    d = base.withColumn("_t", trials).select("*", F.col("_t.f").alias("_f"), F.col("_t.r").alias("_r")).drop("_t")
    place = lambda *order: F.row_number().over(Window.partitionBy("_f", "_r", "_g").orderBy(*order))
    mixed = F.conv(F.substring(F.md5(F.concat_ws(":", "_f", "_r", F.col("_key").cast("string"))), 1, 8), 16, 10).cast("long")
    own = F.coalesce(*(F.when(F.col("_f") == f, F.col(f)) for f in features))
    there = d.where("_r >= 0").select("_f", "_r", "_g", own.alias("_v"), place(mixed, F.col("_key")).alias("_i"))
    here = d.withColumn("_i", place(F.col("_key"))).join(there, ["_f", "_r", "_g", "_i"], "left")
    here = here.withColumns({f: F.when(F.col("_f") == f, F.col("_v")).otherwise(F.col(f)) for f in features})
    right = F.avg(F.when((F.col("score") >= threshold) == (F.col("_y") == 1), 1.0).otherwise(0.0))
    per = applied(bundle, here.select("_f", "_r", "_y", *features)).groupBy("_f", "_r").agg(right.alias("acc"))
    plain = per.where("_r < 0").select(F.col("acc").alias("plain"))
    loss = per.where("_r >= 0").join(F.broadcast(plain)).select(F.col("_f").alias("feature"), (F.col("plain") - F.col("acc")).alias("loss"))
    return loss.groupBy("feature").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std")).orderBy(F.desc("mean"), "feature")


def grid_search(d: DataFrame, key: str, label: str, group: str, features: list[str], grid: list[dict] | None = None, folds: int = 5) -> DataFrame:
    """Average precision of each configuration on each fold of whole groups: ``(config, part, average_precision)``; ``config`` is its JSON."""
    grid = configurations() if grid is None else grid
    d = measured(d, key, group, label, *features)
    parts = {str(f): F.when(fold_of(F.col(group), folds) == f, TEST).otherwise(TRAIN) for f in range(folds)}
    runs = [{"config": json.dumps(c, sort_keys=True), "part": p, "features": features, "params": DEFAULTS | c} for c in grid for p in parts]
    return average_precision(experiments(d, key, label, features, runs, parts), "score", "label", ["config", "part"])


def gap_ratio(folds: DataFrame, default: dict | None = None) -> DataFrame:
    """The best configuration's lead over the default one, by the deviation over folds of both together."""
    name = json.dumps(default or DEFAULTS, sort_keys=True)
    g = folds.groupBy("config").agg(F.avg("average_precision").alias("m"), F.var_pop("average_precision").alias("v"))
    best, own = F.max_by(F.struct("config", "m", "v"), F.struct("m", "config")), F.max(F.when(F.col("config") == name, F.struct("m", "v")))
    g = g.agg(F.count("*").alias("n_configs"), best.alias("b"), own.alias("d"))
    gap = F.col("b.m") - F.col("d.m")
    return g.select(
        "n_configs", F.col("b.config").alias("best"), F.col("b.m").alias("best_mean"), F.col("d.m").alias("default_mean"), gap.alias("gap"),
        F.sqrt(F.col("b.v") + F.col("d.v")).alias("pooled"), X.ratio(gap, F.sqrt(F.col("b.v") + F.col("d.v"))).alias("ratio"),
    )


def classification_report(d: DataFrame, score: str, label: str, threshold: float = 0.25) -> DataFrame:
    """Precision, recall, F1 and support of both classes and their plain and weighted means: one row each."""
    c = confusion(d, score, label, F.lit(threshold), [])
    f1 = lambda p, r: X.ratio(2 * p * r, p + r)
    neg_p, neg_r = X.ratio(F.col("tn"), F.col("tn") + F.col("fn")), X.ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    c = c.select("precision", "recall", (F.col("tp") + F.col("fn")).alias("pos"), (F.col("tn") + F.col("fp")).alias("neg"), neg_p.alias("neg_p"), neg_r.alias("neg_r"))
    c = c.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "neg_f": f1(F.col("neg_p"), F.col("neg_r"))})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.col("pos") + F.col("neg")
    mean = lambda a, b: (zero(a) + zero(b)) / 2
    weighted = lambda a, b: X.ratio(zero(a) * F.col("pos") + zero(b) * F.col("neg"), n)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
    rows = [
        row("FALSE POSITIVE", zero("neg_p"), zero("neg_r"), zero("neg_f"), F.col("neg")), row("CONFIRMED", zero("precision"), zero("recall"), zero("f1"), F.col("pos")),
        row("macro avg", mean("precision", "neg_p"), mean("recall", "neg_r"), mean("f1", "neg_f"), n),
        row("weighted avg", weighted("precision", "neg_p"), weighted("recall", "neg_r"), weighted("f1", "neg_f"), n),
    ]
    return c.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
