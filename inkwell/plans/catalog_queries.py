"""Catalogue, hierarchy, profiling, semi-structured data and keyed state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from inkwell.operators.ranking import placed, top_k_per_group
from inkwell.sources.tables import table
from inkwell.streaming.quota import daily_quota, rate_limited


def catalogue_filter(author: str | None = None, tune: str | None = None, q: str | None = None, author_column: str = "p_brand", tune_columns: tuple[str, ...] = ("p_type", "p_name"), text_columns: tuple[str, ...] = ("p_name", "p_brand", "p_type")) -> Column:
    """Blank parameters do not filter; every word of q must occur, as it is, in some text column; case is ignored."""
    out = F.lit(True)
    if author and author.strip():
        out &= F.col(author_column) == author.strip()
    if tune and tune.strip():
        out &= reduce(lambda a, b: a | b, [F.col(c) == tune.strip() for c in tune_columns])
    for word in (q or "").split():
        out &= reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower())) for c in text_columns])
    return out


def catalog_page(spark, d):
    """The third page of ten, with the total of the same filter on each row."""
    part = table(spark, d, "part").filter(catalogue_filter(q=" 1 "))
    total = part.agg(F.count("*").alias("total"))
    page = part.orderBy("p_partkey").offset(20).limit(10).select("p_partkey", "p_name", F.coalesce(F.substring("p_name", 1, 8), F.lit("")).alias("incipit"))
    return page.join(F.broadcast(total), F.lit(True))  # one row


CATALOG_PAGE = """WITH f AS (SELECT * FROM part WHERE contains(lower(coalesce(p_name, '')), '1') OR contains(lower(coalesce(p_brand, '')), '1') OR contains(lower(coalesce(p_type, '')), '1'))
SELECT p_partkey, p_name, substr(p_name, 1, 8) AS incipit, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_partkey LIMIT 10 OFFSET 20"""


def catalog_search(spark, d):
    return table(spark, d, "customer").filter(catalogue_filter(author="BUILDING", q="customer 00", author_column="c_mktsegment", text_columns=("c_name", "c_mktsegment"))).select("c_custkey", "c_name", "c_acctbal")


CATALOG_SEARCH = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), 'customer') OR contains(lower(c_mktsegment), 'customer')) AND (contains(lower(c_name), '00') OR contains(lower(c_mktsegment), '00'))"


def daily_pick(spark, d):
    """The part of each day: the first 8 bytes of SHA-256 of the ISO date, modulo the number of parts, is the place."""
    days = table(spark, d, "events").select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day")).distinct()
    parts = table(spark, d, "part").select("p_partkey")
    n = parts.count()
    place = (F.conv(F.substring(F.sha2("day", 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")
    return days.withColumn("place", place).join(placed(parts, [F.col("p_partkey")]), "place").select("day", "place", "p_partkey")


DAILY_PICK = """WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part), dd AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT day, place, p_partkey FROM (SELECT day, (('0x' || substr(sha256(day), 1, 16))::UBIGINT % (SELECT count(*) FROM part))::BIGINT AS place FROM dd) JOIN p USING (place)"""


def neighbours_by_order(spark, d):
    """Previous and next part of the same brand."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, d, "part").select("p_brand", "p_partkey", F.lag("p_partkey").over(w).alias("previous"), F.lead("p_partkey").over(w).alias("next"))


NEIGHBOURS = "SELECT p_brand, p_partkey, lag(p_partkey) OVER w AS previous, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"


def hierarchy_sections(spark, d):
    """Suppliers under nation and region, those with a line item only, ordered keys of the tree."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    s = table(spark, d, "supplier").join(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    out = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    path = F.concat_ws("/", "r_name", "n_name", "s_name")
    return out.select("s_suppkey", "r_name", "n_name", path.alias("path"), F.substring(F.sha2(path, 256), 1, 16).alias("node_id"))


HIERARCHY = """SELECT s_suppkey, r_name, n_name, r_name || '/' || n_name || '/' || s_name AS path, substr(sha256(r_name || '/' || n_name || '/' || s_name), 1, 16) AS node_id
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)"""


def point_lookup(spark, d):
    """Wanted keys with their part, or a mark that it is missing."""
    wanted = spark.range(1, 3_000_000, 100_003).select(F.col("id").alias("p_partkey")).union(spark.range(1, 20).select(F.col("id").alias("p_partkey")))
    return F.broadcast(wanted.distinct()).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left").select("p_partkey", "p_name", F.col("p_name").isNull().alias("missing"))


POINT_LOOKUP = "SELECT k AS p_partkey, p_name, p_name IS NULL AS missing FROM (SELECT range AS k FROM range(1, 3000000, 100003) UNION SELECT range FROM range(1, 20)) LEFT JOIN part ON k = p_partkey"


def label_counts(spark, d):
    """Counts of known labels of each source, largest first; rank by count, then label."""
    g = table(spark, d, "documents").filter(F.col("source").isNotNull() & F.col("lang").isNotNull()).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang")))


LABEL_COUNTS = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang)::INT AS place FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)"


def numeric_stats(spark, d):
    """min, median, mean, nearest-rank 90th percentile, max of text lengths by language."""
    n = F.char_length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.min(n).alias("lo"), F.median(n).alias("median"), F.round(F.avg(n), 2).alias("mean"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY char_length(text))").cast("long").alias("p90"), F.max(n).alias("hi"))


NUMERIC_STATS = "SELECT lang, min(length(text))::INT AS lo, median(length(text)) AS median, round(avg(length(text)), 2) AS mean, quantile_disc(length(text), 0.9)::BIGINT AS p90, max(length(text))::INT AS hi FROM documents GROUP BY lang"


def rounded_percentiles(spark, d):
    """The element at round-half-even((n - 1) p) of the sorted totals, p = .5, .9, .99, by status."""
    o = table(spark, d, "orders")
    # counts of each value come first: what is gathered is the distinct values of a group in a window, not the rows in an array
    v = o.groupBy("o_orderstatus", "o_totalprice").agg(F.count("*").alias("c"))
    w = Window.partitionBy("o_orderstatus").orderBy("o_totalprice").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("o_orderstatus")))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(p)), F.col("o_totalprice")))
    return v.groupBy("o_orderstatus").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


ROUNDED = """WITH s AS (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
SELECT o_orderstatus, v[round_even((len(v) - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((len(v) - 1) * 0.9, 0)::INT + 1] AS p90, v[round_even((len(v) - 1) * 0.99, 0)::INT + 1] AS p99 FROM s"""

BUCKETS = [(0, 99), (100, 499), (500, 1999), (2000, 9999), (10000, 10**9), (10**9 + 1, 2 * 10**9)]


def length_buckets(spark, d):
    """Histogram of text lengths in closed ranges; empty ranges count 0."""
    n = F.char_length("text")
    bucket = reduce(lambda c, b: c.when(n.between(*b[1]), b[0]), enumerate(BUCKETS), F.when(F.lit(False), -1))
    held = table(spark, d, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(len(BUCKETS)).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


LENGTH_BUCKETS = "SELECT b::INT AS bucket, count(doc_id) AS n FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(BUCKETS)) + ") v(b, lo, hi) LEFT JOIN documents ON length(text) BETWEEN lo AND hi GROUP BY 1"


def group_profile(spark, d):
    """Sources: records, records with a label, coverage, labels per record, median length; 30 largest."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("grp"), F.char_length("text").alias("n"))
    lab = table(spark, d, "labels").groupBy("doc_id").agg((F.count("quality") + F.count("toxic")).alias("items"))
    g = docs.join(lab, "doc_id", "left").groupBy("grp").agg(F.count("*").alias("records"), F.count("items").alias("with_items"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.median("n").alias("median_length"))
    g = g.withColumn("coverage", F.round(F.try_divide("with_items", "records"), 4)).withColumn("per_record", F.round(F.try_divide("items", "records"), 4)).withColumn("per_annotated", F.round(F.try_divide("items", "with_items"), 4))
    return g.orderBy(F.desc("items"), F.desc("records"), "grp").limit(30)


GROUP_PROFILE = """WITH l AS (SELECT doc_id, count(quality) + count(toxic) AS items FROM labels GROUP BY 1),
g AS (SELECT coalesce(source, '(none)') AS grp, count(*) AS records, count(items) AS with_items, coalesce(sum(items), 0)::BIGINT AS items, median(length(text)) AS median_length FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1)
SELECT *, round(with_items / records, 4) AS coverage, round(items / records, 4) AS per_record, round(CASE WHEN with_items > 0 THEN items / with_items END, 4) AS per_annotated FROM g ORDER BY items DESC, records DESC, grp LIMIT 30"""


def cooccurrence_lift(spark, d):
    """Pairs of brands in one order: count, marginals, lift. Pairs come from each order's own list of distinct brands."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    sets = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("s"))
    n = sets.count()
    single = sets.select(F.explode("s").alias("b")).groupBy("b").agg(F.count("*").alias("c"))
    pair = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    x, y = single.select(F.col("b").alias("a"), F.col("c").alias("n_a")), single.select("b", F.col("c").alias("n_b"))
    return pair.join(x, "a").join(y, "b").select("a", "b", "n", "n_a", "n_b", F.round(F.lit(n) * F.col("n") / (F.col("n_a") * F.col("n_b")), 6).alias("lift"))


LIFT = """WITH s AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT b, count(*) AS c FROM s GROUP BY 1), t AS (SELECT count(DISTINCT o) AS n FROM s),
p AS (SELECT x.b AS a, y.b AS b, count(*) AS n FROM s x JOIN s y ON x.o = y.o AND x.b < y.b GROUP BY ALL)
SELECT a, p.b, p.n, ma.c AS n_a, mb.c AS n_b, round(t.n * p.n / (ma.c * mb.c), 6) AS lift FROM p JOIN m ma ON ma.b = a JOIN m mb ON mb.b = p.b, t"""


def top3_per_group(spark, d):
    g = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment", "c_custkey").agg(F.count("*").alias("n"))
    return top_k_per_group(g, ["c_mktsegment"], [F.desc("n"), F.col("c_custkey")], 3)


TOP3 = "SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_custkey)::INT AS rank FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL) QUALIFY rank <= 3"


def ordered_fingerprint(spark, d):
    """SHA-256 over the rows of a small table in order, one a nation's region."""
    s = F.concat_ws("|", "n_nationkey", "n_name")
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", s.alias("s")))), lambda x: x["s"]), ","), 256).alias("digest"))


ORDERED_FP = "SELECT n_regionkey, count(*) AS n, sha256(string_agg(n_nationkey || '|' || n_name, ',' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1"


def contiguity_audit(spark, d):
    """Rows, distinct keys, whether they are 1 to n, longest name, names with a digit 9."""
    p = table(spark, d, "part")
    g = p.agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("u"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"), F.max(F.char_length("p_name")).alias("longest"), F.count_if(F.contains("p_name", F.lit("9"))).alias("suspects"))
    return g.select("n", "u", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("u") == F.col("n"))).alias("contiguous"), "longest", "suspects")


CONTIGUITY = "SELECT count(*) AS n, count(DISTINCT p_partkey) AS u, min(p_partkey) = 1 AND max(p_partkey) = count(*) AND count(DISTINCT p_partkey) = count(*) AS contiguous, max(length(p_name))::INT AS longest, count(*) FILTER (contains(p_name, '9')) AS suspects FROM part"


def longest_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").alias("n")).orderBy(F.desc("n"), F.desc("doc_id")).limit(15)


LONGEST = "SELECT doc_id, length(text)::INT AS n FROM documents ORDER BY n DESC, doc_id DESC LIMIT 15"


def structure_matrix(spark, d):
    """Sources by number of lines (1, 2 to 5, more), with flags."""
    n = F.size(F.split("text", "\n"))
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(n == 1).alias("one"), F.count_if(n.between(2, 5)).alias("few"), F.count_if(n > 5).alias("many"), F.count_if(F.contains("text", F.lit("\n\n"))).alias("blank_lines"))


STRUCTURE = "SELECT source, count(*) FILTER (k = 1) AS one, count(*) FILTER (k BETWEEN 2 AND 5) AS few, count(*) FILTER (k > 5) AS many, count(*) FILTER (contains(text, chr(10) || chr(10))) AS blank_lines FROM (SELECT *, len(string_split(text, chr(10))) AS k FROM documents) GROUP BY source"


def conflicting_labels(spark, d):
    """Keys with more than one value: `unknown`, else the value."""
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.when(F.countDistinct(F.regexp_extract("html", '<html lang="([^"]*)"', 1)) == 1, F.min(F.regexp_extract("html", '<html lang="([^"]*)"', 1))).otherwise("unknown").alias("lang"))


CONFLICTS = """SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN count(DISTINCT regexp_extract(html, '<html lang="([^"]*)"', 1)) = 1 THEN min(regexp_extract(html, '<html lang="([^"]*)"', 1)) ELSE 'unknown' END AS lang FROM pages GROUP BY 1"""


def balanced_sample(spark, d):
    """Round robin over sources: members and sources in an order of hashes; 30 rows."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", "source")
    turn = top_k_per_group(docs, ["source"], [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), F.col("doc_id")], 30, "turn")
    return turn.orderBy("turn", F.md5(F.concat(F.lit("7:"), F.col("source"))), "source").limit(30)


BALANCED = "WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id)::INT AS turn FROM documents WHERE source IS NOT NULL) SELECT * FROM t ORDER BY turn, md5('7:' || source), source LIMIT 30"


def stratified_sample(spark, d):
    """Two rows of each stratum (toxic, low quality, the rest), a document in its first stratum only."""
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("stratum"))
    one = lab.groupBy("doc_id").agg(F.min("stratum").alias("stratum"))
    return top_k_per_group(one, ["stratum"], [F.md5(F.col("doc_id").cast("string"))], 2)


STRATIFIED = "WITH o AS (SELECT doc_id, min(CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END)::INT AS stratum FROM labels GROUP BY 1) SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR))::INT AS rank FROM o QUALIFY rank <= 2"


def carry_forward(spark, d):
    """Events of a user with the last purchase value so far, and the types before and after."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"), F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))


CARRY = "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def running_offsets(spark, d):
    """Start and end of each line item within its order, and whether the last end is the order's sum."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q").rowsBetween(Window.unboundedPreceding, 0)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    out = li.withColumn("end", F.sum("q").over(w)).withColumn("total", F.sum("q").over(Window.partitionBy("l_orderkey")))
    return out.select("l_orderkey", "l_linenumber", (F.col("end") - F.col("q")).alias("start"), "end", (F.col("end") == F.col("total")).alias("complete"))


OFFSETS = 'SELECT l_orderkey, l_linenumber, (e - q)::BIGINT AS start, e::BIGINT AS "end", e = t AS complete FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS e, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)'


def history_window(spark, d):
    """The last three turns before each user turn, oldest first."""
    c = table(spark, d, "conversations").filter("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return c.withColumn("history", F.array_join(F.transform(F.collect_list(F.struct("role", "turn")).over(w), lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), ",")).filter("role = 'user'").select("conv_id", "turn", "history")


HISTORY = "SELECT conv_id, turn, coalesce(history, '') AS history FROM (SELECT *, string_agg(role || ':' || turn, ',' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM conversations WHERE role <> 'system') WHERE role = 'user'"


def turn_validation(spark, d):
    """First rule that a conversation breaks: first role, alternation, 4,000 characters in all; else ok."""
    c = table(spark, d, "conversations").filter("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("i", F.row_number().over(w)).withColumn("used", F.sum(F.char_length("text")).over(w))
    bad = F.when((F.col("i") % 2 == 1) & (F.col("role") != "user") & (F.col("i") == 1), "first_role").when(F.col("role") != F.when(F.col("i") % 2 == 1, "user").otherwise("assistant"), "alternation").when(F.col("used") > 4000, "budget")
    return c.withColumn("bad", bad).groupBy("conv_id").agg(F.count("*").alias("turns"), F.coalesce(F.min(F.when(F.col("bad").isNotNull(), F.struct("i", "bad")))["bad"], F.lit("ok")).alias("verdict"))


TURNS = """WITH c AS (SELECT conv_id, role, row_number() OVER w AS i, sum(length(text)) OVER w AS used FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, CASE WHEN i = 1 AND role <> 'user' THEN 'first_role' WHEN role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END THEN 'alternation' WHEN used > 4000 THEN 'budget' END AS bad FROM c)
SELECT conv_id, count(*) AS turns, coalesce(min_by(bad, i) FILTER (bad IS NOT NULL), 'ok') AS verdict FROM b GROUP BY 1"""


def event_props(spark, d):
    """JSON payloads: parsed values by type, with rows that do not parse."""
    v = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(v).alias("k_sum"), F.max(v).alias("k_max"), F.count_if(v.isNull()).alias("broken"))


PROPS = "SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k_sum, max((props->>'$.k')::INT) AS k_max, count(*) FILTER ((props->>'$.k') IS NULL) AS broken FROM events GROUP BY 1"


def nested_caps(spark, d):
    """Regions to nations to suppliers as nested arrays, flattened again with caps of 2 and 2."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("pages"))
    n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    r = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "pages"))).alias("volumes"))
    flat = r.select("n_regionkey", F.explode(F.slice("volumes", 1, 2)).alias("v")).select("n_regionkey", "v.n_nationkey", F.explode(F.slice("v.pages", 1, 2)).alias("page"))
    return flat


NESTED = "SELECT n_regionkey, n_nationkey, s_suppkey AS page FROM (SELECT *, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS p FROM nation JOIN supplier ON s_nationkey = n_nationkey) WHERE v <= 2 AND p <= 2"


def manifest_mismatch(spark, d):
    """Two manifests (counts of two tables by key) compared key by key; only differences."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg((F.count("*") * 15).alias("b"))
    return a.join(b, "key", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


MANIFEST = "SELECT key, a, b FROM (SELECT c_nationkey AS key, count(*) AS a FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS key, count(*) * 15 AS b FROM supplier GROUP BY 1) USING (key) WHERE a IS DISTINCT FROM b"


def presence_and_entries(spark, d):
    """Types of events: entries, users that have one, users that have two or more."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return e.groupBy("event_type").agg(F.sum("n").alias("entries"), F.count("*").alias("users"), F.count_if(F.col("n") > 1).alias("repeaters"))


PRESENCE = "SELECT event_type, sum(n)::BIGINT AS entries, count(*) AS users, count(*) FILTER (n > 1) AS repeaters FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1"


def latency_summary(spark, d):
    """p50 (median), p95 (nearest rank), min and max of each metric of the line items."""
    li = table(spark, d, "lineitem").selectExpr("stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'tax', l_tax) AS (metric, v)")
    return li.groupBy("metric").agg(F.median("v").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"), F.min("v").alias("lo"), F.max("v").alias("hi"))


LATENCY = "WITH u AS (UNPIVOT (SELECT l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax FROM lineitem) ON quantity, price, tax INTO NAME metric VALUE v) SELECT metric, median(v) AS p50, quantile_disc(v, 0.95) AS p95, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1"


def quota_by_day(spark, d):
    """Requests accepted under 10 a client and 150 in all per UTC day."""
    return daily_quota(table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), "ts"), 3, 150).groupBy("day", "verdict").agg(F.count("*").alias("n"))


QUOTA = """WITH a AS (SELECT event_id, user_id, ts, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id) AS own FROM events),
b AS (SELECT *, CASE WHEN own <= 3 THEN row_number() OVER (PARTITION BY day, own <= 3 ORDER BY ts, event_id) END AS place FROM a)
SELECT day, CASE WHEN own > 3 THEN 'client' WHEN place > 150 THEN 'total' ELSE 'ok' END AS verdict, count(*) AS n FROM b GROUP BY ALL"""


def rate_limit(spark, d):
    """Accepted and refused requests under two in any 6 hours of a client; a refused one does not count."""
    out = rate_limited(table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), "ts"), 2, 6 * 3600)
    return out.groupBy("accepted").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


#: Requests of a client one after the other, with the times of the last two that were accepted.
RATE_LIMIT = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, true AS accepted, ts AS last, NULL::TIMESTAMP AS before FROM e WHERE i = 1
UNION ALL SELECT e.event_id, e.user_id, e.i, r.before IS NULL OR r.before < e.ts - INTERVAL 6 HOUR, CASE WHEN r.before IS NULL OR r.before < e.ts - INTERVAL 6 HOUR THEN e.ts ELSE r.last END,
 CASE WHEN r.before IS NULL OR r.before < e.ts - INTERVAL 6 HOUR THEN r.last ELSE r.before END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT accepted, count(*) AS n, sum(event_id)::BIGINT AS ids FROM r GROUP BY 1"""


def sessions(spark, d):
    """Sessions of users with gaps of two hours."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sessions"))


SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT n, count(*) AS sessions FROM c GROUP BY 1"


def concurrency(spark, d):
    """Most requests open at once per day, if each lasts 10 minutes."""
    e = table(spark, d, "events")
    step = e.select("ts", F.lit(1).alias("x")).union(e.select(F.expr("ts + INTERVAL 10 MINUTES").alias("ts"), F.lit(-1).alias("x"))).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("day").orderBy("ts", "x")
    return step.withColumn("open", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("day").agg(F.max("open").alias("peak"))


CONCURRENCY = "WITH s AS (SELECT ts, 1 AS x FROM events UNION ALL SELECT ts + INTERVAL 10 MINUTE, -1 FROM events), o AS (SELECT ts::DATE AS day, sum(x) OVER (PARTITION BY ts::DATE ORDER BY ts, x ROWS UNBOUNDED PRECEDING) AS o FROM s) SELECT day, max(o)::BIGINT AS peak FROM o GROUP BY 1"


def ext_rollup(spark, d):
    """Revenue by region and nation with subtotals (an extension)."""
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


ROLLUP = "SELECT n_regionkey, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)"

QUERIES = {
    "catalog_page": (catalog_page, CATALOG_PAGE), "catalog_search": (catalog_search, CATALOG_SEARCH), "daily_pick": (daily_pick, DAILY_PICK), "neighbours_by_order": (neighbours_by_order, NEIGHBOURS),
    "hierarchy_sections": (hierarchy_sections, HIERARCHY), "point_lookup": (point_lookup, POINT_LOOKUP), "label_counts": (label_counts, LABEL_COUNTS), "numeric_stats": (numeric_stats, NUMERIC_STATS),
    "rounded_percentiles": (rounded_percentiles, ROUNDED), "length_buckets": (length_buckets, LENGTH_BUCKETS), "group_profile": (group_profile, GROUP_PROFILE), "cooccurrence_lift": (cooccurrence_lift, LIFT),
    "top3_per_group": (top3_per_group, TOP3), "ordered_fingerprint": (ordered_fingerprint, ORDERED_FP), "contiguity_audit": (contiguity_audit, CONTIGUITY), "longest_texts": (longest_texts, LONGEST),
    "structure_matrix": (structure_matrix, STRUCTURE), "conflicting_labels": (conflicting_labels, CONFLICTS), "balanced_sample": (balanced_sample, BALANCED), "stratified_sample": (stratified_sample, STRATIFIED),
    "carry_forward": (carry_forward, CARRY), "running_offsets": (running_offsets, OFFSETS), "history_window": (history_window, HISTORY), "turn_validation": (turn_validation, TURNS), "event_props": (event_props, PROPS),
    "nested_caps": (nested_caps, NESTED), "manifest_mismatch": (manifest_mismatch, MANIFEST), "presence_and_entries": (presence_and_entries, PRESENCE), "latency_summary": (latency_summary, LATENCY),
    "quota_by_day": (quota_by_day, QUOTA), "rate_limit": (rate_limit, RATE_LIMIT), "sessions": (sessions, SESSIONS), "concurrency": (concurrency, CONCURRENCY), "ext_rollup": (ext_rollup, ROLLUP),
}
