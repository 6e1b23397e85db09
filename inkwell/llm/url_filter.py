"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host and a path; it fits a URL whose host is the rule's or one of its
subdomains and whose path starts with the rule's. Each URL is expanded into its
host suffixes times its path prefixes, but only for the numbers of labels and
the path lengths that the rules have, so the work per URL is bounded by the
rules' shapes and not by its length. The SHA-256 of each expression is joined
with the rules on its first 32 bits; full digests then decide, and of the rules
that fit the longest (host and path together) wins.

Rules of up to MAX_BROADCAST rows are broadcast, after a count. Larger sets are
joined by shuffle; there the expressions that many URLs share are met by
replicating the rules over SALTS salts, so no key gathers its URLs in one task.

Defined results: a null URL or one without `://` has an empty host and path; with
no rule that fits, `rule` is null and the verdict is the default; equal rules with
different verdicts block; rows repeat as they do in the input; an empty table or
an empty rule set gives no rule; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import lower_ascii, table

MAX_BROADCAST, SALTS, PREFIX = 100_000, 64, 8
#: The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.expr("substring(_rest, length(_host) + 1)")
    return (
        pages.select(*keep, F.coalesce(rest, F.lit("")).alias("_rest"))
        .withColumn("_host", host)
        .select(*keep, lower_ascii(F.col("_host")).alias("host"), F.regexp_extract(path, r"^[^?#]*", 0).alias("path"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", keep: list[str] | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """keep (page_id), host, path, rule, verdict for each row of `pages`."""
    keep = keep or ["page_id"]
    rules = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
    rules = rules.withColumn("rule", F.concat("r_host", "r_path")).withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    shapes = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    urls = parsed(pages, keep).withColumn("_row", F.monotonically_increasing_id())
    labels = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(labels >= k, F.substring_index("host", ".", -k)) for k in sorted(shapes["labels"])])) if shapes["labels"] else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shapes["lengths"])])) if shapes["lengths"] else F.array().cast("array<string>")
    said = urls.withColumn("_suffix", F.explode_outer(suffixes)).withColumn("_prefix", F.explode_outer(prefixes)).withColumn("e_digest", F.sha2(F.concat_ws("\n", "_suffix", "_prefix"), 256)).withColumn("short", F.substring("e_digest", 1, PREFIX))
    fits = F.col("e_digest").eqNullSafe(F.col("digest")) & (F.col("_suffix") == F.col("r_host")) & (F.col("_prefix") == F.col("r_path"))
    if shapes["n"] <= max_broadcast:
        met = said.join(F.broadcast(rules), "short", "left")
    else:
        salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = said.withColumn("_salt", F.pmod(F.xxhash64(*keep, "_row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "_salt"], "left")
    order = F.when(fits, F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), "verdict", "rule"))  # `block` is after `allow`
    best = met.groupBy("_row", *keep, "host", "path").agg(F.max(order).alias("best"))
    return best.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM rest),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path, row_number() OVER () AS rid FROM cut),
r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT rid, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
      FROM u JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (rid)
"""
