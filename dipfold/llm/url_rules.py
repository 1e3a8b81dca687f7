"""Operator 4. URL filters, in DataFrame operations only.

Each different (host, path) is expanded into expressions: every host suffix at a label bound with every path prefix that ends in
a slash (and the empty one). A rule's key is its host with its path up to the last slash. Expressions and keys meet
by an equi-join on a short hash prefix; a candidate then stands only if the full digest of what the rule covers
of this URL equals the rule's own digest. Of the rules that stand, the longest wins.

Expansions longer than the longest host and key path among the rules cannot match and are not made, so a URL of any length
gives a bounded number of them. Hot hosts and hot URLs are counted once: expressions are made from distinct (host, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfold.llm.common import cut

#: The rules of the query: host, path, verdict.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
DEFAULT = "allow"
PREFIX_BITS = 32


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def short(host: Column, path: Column) -> Column:
    """The short hash prefix by which expressions and rule keys meet."""
    return F.xxhash64(host, path).bitwiseAND(F.lit((1 << PREFIX_BITS) - 1))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` for those of the distinct ``(host, path)`` rows that a rule fits; the longest rule.

    Of rules of one length the one with the longer host wins, then the smaller text, then ``allow`` before ``block``.
    """
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND rule_verdict IS NOT NULL")
    key_path = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    rules = rules.select(
        lower_ascii(F.col("rule_host")).alias("rule_host"), "rule_path", "rule_verdict", key_path.alias("key_path")
    ).withColumns({"short": short(F.col("rule_host"), F.col("key_path")), "digest": digest(F.col("rule_host"), F.col("rule_path"))})
    longest = rules.agg(F.max(F.length("rule_host")).alias("h"), F.max(F.length("key_path")).alias("p")).first()
    h, p = longest.h or 0, longest.p or 0
    # ends of the host within reach, by where a label begins; beginnings of the path within reach, by where a slash stands
    tail = F.substring(F.concat(F.lit("."), F.col("host")), -(h + 1), h + 1)
    head = F.substring(F.col("path"), 1, p)
    tails = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(tail)), lambda i: F.when(F.substring(tail, i, F.lit(1)) == ".", F.substring(tail, i + 1, F.lit(h)))),
        lambda x: x.isNotNull(),
    )
    heads = F.filter(
        F.transform(F.sequence(F.lit(0), F.length(head)), lambda i: F.when((i == 0) | (F.substring(head, i, F.lit(1)) == "/"), F.substring(head, F.lit(1), i))),
        lambda x: x.isNotNull(),
    )
    made = urls.withColumn("suffix", F.explode(tails)).withColumn("prefix", F.explode(heads))
    made = made.withColumn("short", short(F.col("suffix"), F.col("prefix")))
    found = made.join(rules, "short").where(
        (F.col("digest") == digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.length("rule_path"))))
        & (F.col("suffix") == F.col("rule_host"))
    )
    order = F.struct(
        (-F.length("rule_host") - F.length("rule_path")).alias("a"), (-F.length("rule_host")).alias("b"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = found.groupBy("host", "path").agg(F.min(order).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    * A null URL and one without ``://`` have an empty host and path; a rule's host never fits an empty host.
    * A rule fits its host and all subdomains if the path starts with the rule's (byte by byte; an empty path does not start
      with ``/``). Without a rule that fits, ``rule`` is null and ``verdict`` is ``default``.
    * Null ids and repeated rows are kept, each by itself; other columns are ignored; an empty table gives an empty result;
      without rules every page gets ``default``.
    """
    spark = pages.sparkSession
    host, path = parsed(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    best = matches(pages.select("host", "path").where("host <> ''").distinct(), rule_table(spark) if rules is None else rules)
    # no rule fits an empty host: such pages are dealt by their id, not all to the task of one key
    spread = F.when(F.col("host") == "", F.concat(F.lit("\n"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.col("path"))
    best = best.select(F.col("host").alias("rule_of"), F.col("path").alias("rule_deal"), "rule", "verdict")
    return pages.withColumn("deal", spread).join(best, (F.col("host") == F.col("rule_of")) & (F.col("deal") == F.col("rule_deal")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages
), a AS (
  SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM p
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), r(rule_host, rule_path, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(v, length(rule_host || rule_path)) AS v
  FROM (SELECT DISTINCT host, path FROM b) u JOIN r
    ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)
  GROUP BY host, path
)
SELECT page_id, b.host, b.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM b LEFT JOIN m ON b.host = m.host AND b.path = m.path
"""
