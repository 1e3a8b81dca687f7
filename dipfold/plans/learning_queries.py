"""Queries of splits, metrics and boosted trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.operators import learning as L
from dipfold.plans.registry import query
from dipfold.plans.table_queries import HASH
from dipfold.plans.tables import LABELS_SQL, scored_labels, table

H = HASH.format


@query(
    f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders), t AS (SELECT o_custkey, row_number() OVER (ORDER BY {H(seed=42, key='o_custkey')}, o_custkey) <= ceil(0.2 * count(*) OVER ()) AS test FROM g),
v AS (SELECT o_custkey, row_number() OVER (ORDER BY {H(seed=7, key='o_custkey')}, o_custkey) <= ceil(0.25 * count(*) OVER ()) AS val FROM t WHERE NOT test)
SELECT o_orderkey, CASE WHEN test THEN 'test' WHEN val THEN 'validation' ELSE 'train' END AS part FROM orders JOIN t USING (o_custkey) LEFT JOIN v USING (o_custkey)"""
)
def group_split(spark, d):
    return L.split(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "part")


@query(f"SELECT CAST({H(seed=0, key='o_custkey')} % 5 AS INTEGER) AS fold, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY ALL")
def group_folds(spark, d):
    o = table(spark, d, "orders").withColumn("fold", L.fold_of(F.col("o_custkey")))
    return o.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"))


CONFUSION = """count_if(score >= {t} AND label = 1) AS tp, count_if(score >= {t} AND label <> 1) AS fp, count_if(score < {t} AND label = 1) AS fn, count_if(score < {t} AND label <> 1) AS tn"""


@query(
    f"""WITH {LABELS_SQL}, c AS (SELECT source, {CONFUSION.format(t='.25')} FROM scored GROUP BY ALL)
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
  (tn + fn) / (tp + fp + fn + tn) AS queue_cut, fn / nullif(tp + fn, 0) AS lost FROM c"""
)
def confusion(spark, d):
    return L.confusion(scored_labels(spark, d), "score", "label", F.lit(0.25), ["source"])


SWEEP = " UNION ALL ".join(f"SELECT {t} AS threshold, {CONFUSION.format(t=t)} FROM scored" for t in L.THRESHOLDS)


@query(f"WITH {LABELS_SQL}, c AS ({SWEEP}) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c")
def threshold_sweep(spark, d):
    return L.threshold_sweep(scored_labels(spark, d), "score", "label")


@query(
    f"""WITH {LABELS_SQL}, r AS (SELECT source, label, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2 AS r FROM scored),
g AS (SELECT source, count_if(label = 1) AS n_pos, count_if(label <> 1) AS n_neg, sum(r) FILTER (label = 1) AS s FROM r GROUP BY ALL)
SELECT source, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / nullif(n_pos * n_neg, 0), 9) AS auc FROM g"""
)
def roc_auc(spark, d):
    return L.roc_auc(scored_labels(spark, d), "score", "label", ["source"]).withColumn("auc", F.round("auc", 9))


@query(
    f"""WITH {LABELS_SQL}, s AS (SELECT source, score, count_if(label = 1) AS pos, count(*) AS n FROM scored GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM s WINDOW w AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT source, round(sum(pos * tp / al) / nullif(sum(pos), 0), 9) AS average_precision FROM c GROUP BY ALL"""
)
def average_precision(spark, d):
    return L.average_precision(scored_labels(spark, d), "score", "label", ["source"]).withColumn("average_precision", F.round("average_precision", 9))


SEEDS = 25


def _ablation(spark, d):
    """Accuracy of two scores on a fifth of the documents, for 25 seeds."""
    s = scored_labels(spark, d)
    rows = s.withColumn("seed", F.explode(F.sequence(F.lit(100), F.lit(99 + SEEDS)))).where(
        F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") < int(0.2 * (1 << 32))
    )
    hit = lambda t: F.avg(F.when((F.col("score") >= t) == (F.col("label") == 1), 1.0).otherwise(0.0))
    g = rows.groupBy("seed").agg(hit(0.25).alias("low"), hit(0.5).alias("high"))
    return g.select("seed", F.expr("stack(2, 'low', low, 'high', high) AS (config, acc)"))


@query(
    f"""WITH {LABELS_SQL}, seeds AS (SELECT unnest(generate_series(100, {99 + SEEDS})) AS seed),
a AS (SELECT seed, avg(CASE WHEN (score >= .25) = (label = 1) THEN 1.0 ELSE 0 END) - avg(CASE WHEN (score >= .5) = (label = 1) THEN 1.0 ELSE 0 END) AS d
  FROM scored CROSS JOIN seeds WHERE ('0x' || substr(md5(seed || ':' || doc_id), 1, 8))::BIGINT < {int(0.2 * (1 << 32))} GROUP BY ALL),
g AS (SELECT avg(d) AS mean, stddev_pop(d) AS sd, count(d) AS n, count_if(d > 0) AS wins FROM a)
SELECT round(mean, 9) AS mean, round(sd, 9) AS sd, n, wins, round(mean / nullif(sd / sqrt(n), 0), 6) AS t, abs(mean / nullif(sd / sqrt(n), 0)) > 2 AS real FROM g"""
)
def paired_ablation(spark, d):
    out = L.paired(_ablation(spark, d), "low", "high", "config", "seed", "acc")
    return out.withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 9), "t": F.round("t", 6)})


@query(f"WITH {LABELS_SQL} SELECT source, count(*) AS n, max(y) / count(*) AS majority FROM (SELECT source, count(*) OVER (PARTITION BY source, label) AS y FROM scored) GROUP BY ALL")
def majority_baseline(spark, d):
    per = scored_labels(spark, d).groupBy("source", "label").agg(F.count("*").alias("y"))
    return per.groupBy("source").agg(F.sum("y").alias("n"), (F.max("y") / F.sum("y")).alias("majority"))


FEATURES = ["depth", "snr", "length", "lines", "digits"]
FAMILIES = {"all": FEATURES, "three": ["depth", "snr", "length"], "two": ["lines", "digits"], "length": ["length"], "depth": ["depth"]}


def training_rows(spark, d):
    """Labelled documents with five measurements, some of them missing."""
    docs = table(spark, d, "documents")
    number = lambda chars: F.regexp_count("text", F.lit(chars))
    words = F.regexp_count("text", F.lit(r"\S+")).cast("double")
    marks = number("[!|#$%&*]")
    f = docs.select(
        "doc_id", F.when(words > 60, words).alias("length"), (marks / F.length("text")).alias("depth"),
        F.when(F.col("doc_id") % 3 > 0, F.length("text") - F.length(F.lower("text")) + words / F.length("text")).alias("snr"),
        number("\n").cast("double").alias("lines"), (number("[0-9]") / F.length("text")).alias("digits"),
    )
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(f, "doc_id")


def rounded(out):
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query()
def gbt_score(spark, d):
    """Boosted trees at a hundred rounds, fitted on all rows of the train groups and applied to the others; no SQL."""
    rows = X.kept(L.split(training_rows(spark, d), "doc_id"))
    bundle = L.fitted(rows.where("part = 'train'"), "doc_id", "label", FEATURES)
    return rounded(L.applied(bundle, rows.where("part <> 'train'")).select("doc_id", "part", "label", "score"))


@query()
def permutation_importance(spark, d):
    """Thirty repeats of every feature."""
    rows = X.kept(L.split(training_rows(spark, d), "doc_id"))
    bundle = L.fitted(rows.where("part = 'train'"), "doc_id", "label", FEATURES)
    return rounded(L.permutation_importance(bundle, rows.where("part <> 'train'"), "label", "doc_id"))


@query()
def group_cv(spark, d):
    """All 32 configurations on five folds of whole groups, and the best one's lead over the default."""
    return rounded(L.gap_ratio(L.grid_search(training_rows(spark, d), "doc_id", "label", "doc_id", FEATURES)))


@query()
def family_ablation(spark, d):
    """Five feature families, each fitted on 25 grouped splits."""
    return rounded(L.spread(L.ablation(training_rows(spark, d), "doc_id", "doc_id", "label", FAMILIES, list(range(100, 125)))))


@query()
def family_pairs(spark, d):
    """What more features add, paired over the splits."""
    found = X.kept(L.ablation(training_rows(spark, d), "doc_id", "doc_id", "label", {k: FAMILIES[k] for k in ("all", "three", "length")}, list(range(100, 125))))
    one = lambda a, b: L.paired(found, a, b, "config", "part", "accuracy").withColumn("pair", F.lit(f"{a} - {b}"))
    return rounded(one("all", "three").unionByName(one("three", "length")))


@query()
def inner_against_outer(spark, d):
    return rounded(L.inner_against_outer(training_rows(spark, d), "doc_id", "doc_id", "label", FEATURES))


@query()
def feature_baselines(spark, d):
    return rounded(L.baselines(training_rows(spark, d), "doc_id", "doc_id", "label", FEATURES, "length"))


@query()
def scored_queue(spark, d):
    """A model is fitted, stored, read back and applied to the rows that are not for training; every row has its place in the queue."""
    rows = X.kept(L.split(training_rows(spark, d), "doc_id"))
    path = f"{spark.sparkContext.getCheckpointDir()}/bundle-{uuid.uuid4().hex}"
    L.save_bundle(spark, L.fitted(rows.where("part = 'train'"), "doc_id", "label", FEATURES), path)
    bundle, _ = L.load_bundle(spark, path)
    return rounded(L.queue(bundle, rows.where("part <> 'train'").select("doc_id", *FEATURES), "doc_id").select("doc_id", "score", "place"))


REPORT = """r AS (SELECT count_if(score >= .25 AND label = 1) AS tp, count_if(score >= .25 AND label <> 1) AS fp, count_if(score < .25 AND label = 1) AS fn, count_if(score < .25 AND label <> 1) AS tn FROM scored),
s AS (SELECT 'CONFIRMED' AS name, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, tp + fn AS support FROM r
  UNION ALL SELECT 'FALSE POSITIVE', coalesce(tn / nullif(tn + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0), tn + fp FROM r),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM s)"""


@query(
    f"""WITH {LABELS_SQL}, {REPORT} SELECT name, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f"""
)
def classification_report(spark, d):
    out = L.classification_report(scored_labels(spark, d), "score", "label")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"WITH {LABELS_SQL} SELECT doc_id, CASE WHEN score >= .25 THEN 1 ELSE 0 END AS predicted FROM scored")
def thresholded(spark, d):
    return scored_labels(spark, d).select("doc_id", L.predicted(F.col("score")).alias("predicted"))


DISPOSITIONS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'FALSE POSITIVE' ELSE 'CANDIDATE' END AS disposition FROM orders"


def dispositions(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "CONFIRMED").when(s == "O", "FALSE POSITIVE").otherwise("CANDIDATE").alias("disposition"))


@query(f"SELECT *, CASE WHEN disposition = 'CONFIRMED' THEN 1 ELSE 0 END AS label FROM ({DISPOSITIONS}) WHERE disposition IN ('CONFIRMED', 'FALSE POSITIVE')")
def label_encode(spark, d):
    return L.known(dispositions(spark, d))


@query(f"SELECT * FROM ({DISPOSITIONS}) WHERE disposition = 'CANDIDATE'")
def candidates_only(spark, d):
    return L.unknown(dispositions(spark, d))


@query(f"SELECT o_orderkey, {H(seed='x', key='o_orderkey')} AS h FROM orders")
def stable_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.hash_unit(F.col("o_orderkey"), "x").alias("h"))
