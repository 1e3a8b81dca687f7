"""Queries of the table operators over the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.operators import batch, relational, stats
from dipfold.plans.registry import query
from dipfold.plans.tables import table


def orders(spark, d):
    return table(spark, d, "orders")


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_totalprice <= 20000 THEN 'koi_period missing or non-positive' WHEN c_mktsegment IS NULL THEN 'koi_time0bk missing'
  WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'koi_duration missing or non-positive' WHEN c_nationkey < 1 THEN 'koi_num_transits is 0' END AS reason
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
)
def precheck(spark, d):
    o = orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = batch.precheck(F.col("o_totalprice") - 20000, F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey"))
    return o.select("o_orderkey", reason.alias("reason"))


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1"""
)
def dedup_keep_last(spark, d):
    return relational.keep_last(orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders")
def group_size_window(spark, d):
    return relational.group_size(orders(spark, d), "o_custkey").select("o_orderkey", "group_size")


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS stratum, count(*) AS n_rows FROM orders GROUP BY ALL")
def star_stratum(spark, d):
    return relational.strata(orders(spark, d), "o_custkey", F.col("o_orderstatus") == "F")


@query("SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join_lookup(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"])


@query(
    """SELECT a.o_orderkey, a.o_orderstatus, b.o_orderstatus AS o_orderstatus_cat FROM orders a
LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F') b ON a.o_orderkey = b.o_orderkey"""
)
def suffix_join(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_orderstatus")
    return relational.lookup(o, o.where("o_orderstatus = 'F'"), ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    keys = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"))
    return relational.keep_listed(table(spark, d, "customer").select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join(spark, d):
    keys = orders(spark, d).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.drop_listed(table(spark, d, "customer").select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("SELECT o_orderkey, n AS n_of_customer FROM orders LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = k")
def map_lookup(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_custkey")
    return relational.lookup(o, o.groupBy("o_custkey").agg(F.count("*").alias("n_of_customer")), ["o_custkey"]).select("o_orderkey", "n_of_customer")


@query(
    """SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS sibling FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber"""
)
def sibling_pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.sibling_pairs(li, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.explode("siblings").alias("sibling"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, min(value) AS lowest, max(value) AS highest FROM events GROUP BY ALL")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query(
    """SELECT l_returnflag, quantile_cont(l_extendedprice, .01) AS p1, quantile_cont(l_extendedprice, .05) AS p5, quantile_cont(l_extendedprice, .25) AS p25,
  quantile_cont(l_extendedprice, .5) AS p50, quantile_cont(l_extendedprice, .75) AS p75, quantile_cont(l_extendedprice, .95) AS p95,
  quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25) AS iqr FROM lineitem GROUP BY ALL"""
)
def quantiles(spark, d):
    points = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return stats.quantiles(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], points)


@query(
    """WITH b AS (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 WHEN l_quantity > 25 AND l_quantity <= 45 THEN 2 END AS band,
  l_discount - l_tax AS e FROM lineitem)
SELECT band, count(*) AS n, round(median(e), 6) AS median, round(quantile_cont(abs(e), .9), 6) AS p90_abs FROM b WHERE band IS NOT NULL GROUP BY ALL"""
)
def banded_error(spark, d):
    li = table(spark, d, "lineitem").withColumn("e", F.col("l_discount") - F.col("l_tax"))
    out = stats.banded(li, X.in_bands(F.col("l_quantity"), [0, 10, 25, 45]), "e")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p90_abs")})


@query(
    """SELECT l_returnflag, count(*) AS n, count_if(l_discount > .05) AS large, printf('%d/%d (%.1f%%)', count_if(l_discount > .05), count(*), 100.0 * count_if(l_discount > .05) / count(*)) AS share
FROM lineitem GROUP BY ALL"""
)
def conditional_shares(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("large"))
    return g.withColumn("share", X.share_text(F.col("large"), F.col("n")))


@query(
    """WITH h AS (SELECT abs((epoch_us(ts) // 1000) % 1000) / 2000.0 AS x FROM events),
b AS (SELECT CASE WHEN x >= 0 AND x < .1 THEN 0 WHEN x >= .1 AND x < .2 THEN 1 WHEN x >= .2 AND x < .3 THEN 2 WHEN x >= .3 AND x < .4 THEN 3 WHEN x >= .4 AND x < .45 THEN 4
  WHEN x >= .45 AND x <= .5001 THEN 5 END AS bin FROM h) SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL"""
)
def phase_histogram(spark, d):
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000 % 1000")
    return stats.histogram(table(spark, d, "events"), F.abs(ms) / 2000.0, [0, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5001])


@query(
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY ALL"""
)
def spearman(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


HEALTH = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count(v) AS n_null, median(v) AS median, (count(*) - count(v)) / count(*) AS null_rate FROM (SELECT {e} AS v FROM lineitem)"
    for c, e in (("quantity", "nullif(l_quantity, 7)"), ("discount", "nullif(l_discount, 0)"), ("tax", "l_tax"))
)


@query(HEALTH)
def feature_health(spark, d):
    li = table(spark, d, "lineitem").select(F.nullif("l_quantity", F.lit(7.0)).alias("quantity"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.col("l_tax").alias("tax"))
    return stats.column_health(li, ["quantity", "discount", "tax"])


GROUPS = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", count_if(v > 0) AS found, count(v) AS total, median(v) FILTER (v > 0) AS median_found, count_if(v > 0) / count(v) AS share FROM (SELECT l_returnflag, {e} AS v FROM lineitem) GROUP BY l_returnflag"
    for c, e in (("discount", "l_discount"), ("tax", "nullif(l_tax, 0.01)"))
)


@query(GROUPS)
def conditional_groups(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("discount"), F.nullif("l_tax", F.lit(0.01)).alias("tax"))
    return stats.found_by_group(li, "l_returnflag", ["discount", "tax"])


HASH = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY {HASH.format(seed=42, key='c_custkey')}, c_custkey LIMIT 50)")
def sample_stars(spark, d):
    return relational.sample_groups(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 42)


@query(
    f"""WITH s AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS stratum FROM orders GROUP BY ALL)
SELECT o_custkey, stratum, rank FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {HASH.format(seed=42, key='o_custkey')}, o_custkey) AS rank FROM s) WHERE rank <= 20"""
)
def balanced_sample(spark, d):
    return relational.balanced_sample(orders(spark, d), "o_custkey", F.col("o_orderstatus") == "F", 40, 42)


@query("SELECT k AS o_custkey, (row_number() OVER (ORDER BY k) - 1) // 25 AS chunk FROM (SELECT DISTINCT o_custkey AS k FROM orders ORDER BY k LIMIT 100)")
def chunk_stars(spark, d):
    return relational.chunked(orders(spark, d), "o_custkey", 25, 4)


@query("SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def head_per_class(spark, d):
    out = relational.head_per_group(orders(spark, d), "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return out.select("o_orderkey", "o_orderpriority", "rank")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_stack(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    return relational.overlap(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_keys(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def rank_queue(spark, d):
    """Every row with its place; places are counted range by range, no task orders the table."""
    return relational.placed(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    return relational.row_of(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


@query(
    """WITH new AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL)
SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new"""
)
def upsert_latest(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = orders(spark, d).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return relational.upserted(old, new, ["k"])


@query("SELECT s_suppkey, isfinite(x) AND x IS NOT NULL AS finite FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE s_acctbal END AS x FROM supplier)")
def finite_test(spark, d):
    k = F.col("s_suppkey") % 4
    x = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.col("s_acctbal"))
    return table(spark, d, "supplier").select("s_suppkey", X.finite(x).alias("finite"))


@query("SELECT s_suppkey, printf('%.1f%%', s_acctbal / 100) AS percent, printf('%+.1f%%', s_acctbal / 100) AS signed, format('{:,}', CAST(trunc(s_acctbal * 1000) AS BIGINT)) AS thousands FROM supplier")
def number_formats(spark, d):
    a = F.col("s_acctbal")
    percent = lambda signed: F.concat(X.tenths_text(a / 100, signed), F.lit("%"))
    return table(spark, d, "supplier").select("s_suppkey", percent(False).alias("percent"), percent(True).alias("signed"), X.thousands_text((a * 1000).cast("long")).alias("thousands"))


@query(
    """WITH a AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY ALL)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM a WHERE last NOT IN ('1-URGENT', '2-HIGH'))"""
)
def resume_remaining(spark, d):
    checkpoint = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("attempt_seq"), F.col("o_orderpriority").alias("error_kind"))
    return batch.remaining(table(spark, d, "customer").select("c_custkey"), checkpoint, ["c_custkey"], ("1-URGENT", "2-HIGH"))


MESSAGES = """m AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'OSError' WHEN 1 THEN 'ConnectionError' WHEN 2 THEN 'NoDataError' WHEN 3 THEN 'SearchError' WHEN 4 THEN 'ValueError'
  WHEN 5 THEN 'OSError' WHEN 6 THEN 'NoDataError' WHEN 7 THEN 'HTTPError' END AS kind,
  CASE o_orderkey % 9 WHEN 0 THEN 'No space left on device' WHEN 1 THEN 'gone' WHEN 2 THEN 'none for KIC 500' || o_orderkey WHEN 3 THEN 'status 503' WHEN 4 THEN 'covers ' || o_custkey || '.5 of 10'
  WHEN 5 THEN 'error in reading data product x' WHEN 6 THEN 'read timed out' WHEN 7 THEN 'x' END AS message FROM orders)"""


def _messages(spark, d):
    k = F.col("o_orderkey") % 9
    kinds = ["OSError", "ConnectionError", "NoDataError", "SearchError", "ValueError", "OSError", "NoDataError", "HTTPError"]
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    texts = [F.lit("No space left on device"), F.lit("gone"), F.concat(F.lit("none for KIC 500"), key), F.lit("status 503"), F.concat(F.lit("covers "), cust, F.lit(".5 of 10")), F.lit("error in reading data product x"), F.lit("read timed out"), F.lit("x")]
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in range(8):
        kind, text = F.when(k == i, kinds[i]).otherwise(kind), F.when(k == i, texts[i]).otherwise(text)
    return orders(spark, d).select("o_orderkey", kind.alias("kind"), text.alias("message"))


@query(
    "WITH " + MESSAGES + """ SELECT o_orderkey, CASE WHEN kind IS NULL AND message IS NULL THEN '' WHEN contains(lower(message), 'no space left on device') THEN 'diskfull'
  WHEN contains(lower(message), 'error in reading data product') THEN 'corruptcache' WHEN kind IN ('ConnectionError', 'HTTPError') THEN 'transient'
  WHEN contains(lower(message), 'timed out') OR regexp_matches(message, '\\b(500|502|503|504|429)\\b') THEN 'transient' WHEN kind IN ('NoDataError', 'SearchError') THEN 'nodata' ELSE 'unknown' END AS error_kind,
  substr(concat_ws(': ', kind, message), 1, 300) AS error FROM m"""
)
def error_classify(spark, d):
    m = _messages(spark, d)
    return m.select("o_orderkey", batch.classified(F.col("kind"), F.col("message")).alias("error_kind"), batch.error_text(F.col("kind"), F.col("message")).alias("error"))


@query("WITH " + MESSAGES + " SELECT regexp_replace(message, '[0-9]+(\\.[0-9]+)?', 'N', 'g') AS cause, count(*) AS n FROM m WHERE message IS NOT NULL GROUP BY ALL")
def regex_cause(spark, d):
    return stats.value_counts(_messages(spark, d).where("message IS NOT NULL").withColumn("cause", batch.cause(F.col("message"))), "cause")


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity * 75 - 1800) <= 1e-8 + 1e-5 * 1800 AS pinned FROM lineitem")
def cadence_pin(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.close_to(F.col("l_quantity") * 75, 1800.0).alias("pinned"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT CAST(l_quantity AS INT))), '|') AS cadences_seen FROM lineitem GROUP BY ALL")
def cadences_seen(spark, d):
    seen = F.array_join(F.sort_array(F.collect_set(F.col("l_quantity").cast("int"))), "|")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(seen.alias("cadences_seen"))


@query(
    """SELECT o_orderkey, lower(o_orderpriority) AS low, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS padded, split_part(o_orderpriority, '-', 1) AS head,
  substr(o_orderpriority, 1, 3) AS cut, o_orderpriority LIKE '1%' AS first, contains(o_orderpriority, '-') AS dashed, replace(o_orderpriority, '-', '~') AS swapped FROM orders"""
)
def string_functions(spark, d):
    p = F.col("o_orderpriority")
    return orders(spark, d).select(
        "o_orderkey", F.lower(p).alias("low"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("padded"), F.split(p, "-")[0].alias("head"),
        F.substring(p, 1, 3).alias("cut"), p.startswith("1").alias("first"), p.contains("-").alias("dashed"), F.translate(p, "-", "~").alias("swapped"),
    )


@query(
    """SELECT s_suppkey, round_even(s_acctbal, 0) AS even, ((s_suppkey - 50) % 7 + 7) % 7 AS wrapped, abs(s_acctbal) AS size, round(atan2(s_acctbal, s_suppkey), 9) AS angle,
  CASE WHEN s_acctbal > 0 THEN round(sqrt(s_acctbal), 9) END AS root, greatest(CAST(trunc(s_acctbal) AS INT), 5) AS floor5 FROM supplier"""
)
def math_functions(spark, d):
    a = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.rint(a).alias("even"), F.pmod(F.col("s_suppkey") - 50, F.lit(7)).alias("wrapped"), F.abs(a).alias("size"), F.round(F.atan2(a, "s_suppkey"), 9).alias("angle"),
        F.when(a > 0, F.round(F.sqrt(a), 9)).alias("root"), F.greatest(a.cast("int"), F.lit(5)).alias("floor5"),
    )
