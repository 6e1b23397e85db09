"""Annotations, reviews, logs, graphs and diagnostics.

Queries whose text both engines read alike are written once as SQL; the names of tables are those of the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import hashing
from inkwell.functions import text as T
from inkwell.operators.closure import reachable, resolved
from inkwell.operators.lexicon import grams, lookup
from inkwell.sources.tables import cut, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(text: str):
    """(query, oracle) of a text that Spark and the oracle read alike."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def query(spark, d) -> DataFrame:
        body = text
        for t in used:
            body = re.sub(rf"\b{t}\b", "{" + t + "}", body)
        return spark.sql(body, **{t: table(spark, d, t) for t in used})

    return query, text


def lexicon_lookup(spark, d):
    """The parts as a lexicon: the name is the headword, brand and reversed name its variants, name and type the text. Looked up are all words of
    the names, the inner letters of words, their first two letters, and all brands and names: five entries at most, by key."""
    parts = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("headword"), F.lower("p_brand").alias("brand"), F.lower("p_type").alias("type"))
    w = F.split("headword", " ")
    entries = parts.select(F.col("p_partkey"), "headword", F.array(F.col("brand"), F.array_join(F.reverse(w), " ")).alias("variants"), F.concat_ws(" ", "headword", "type").alias("text"))
    asked = F.flatten(F.array(w, F.transform(w, lambda x: F.substring(x, 2, 3)), F.transform(w, lambda x: F.substring(x, 1, 2)), F.array("headword", "brand")))
    return lookup(parts.select(F.explode(asked).alias("term")), entries, cut(grams(entries, "p_partkey")), 5, "p_partkey")


LEXICON = """WITH n AS (SELECT p_partkey, lower(p_name) AS name, lower(p_brand) AS brand, string_split(lower(p_name), ' ') AS w, lower(p_name) || ' ' || lower(p_type) AS text FROM part),
a AS (SELECT DISTINCT unnest(w || list_transform(w, lambda x: substr(x, 2, 3)) || list_transform(w, lambda x: substr(x, 1, 2)) || [name, brand]) AS term FROM n),
e AS (SELECT DISTINCT p_partkey, unnest([name, brand, array_to_string(list_reverse(w), ' ')]) AS term FROM n),
x AS (SELECT term, 0 AS tier, p_partkey FROM e SEMI JOIN a USING (term) UNION ALL SELECT term, 1, p_partkey FROM (SELECT term FROM a WHERE term <> '' AND term NOT IN (SELECT term FROM e WHERE term IS NOT NULL)) JOIN n ON contains(text, term))
SELECT term, tier::INT AS tier, row_number() OVER (PARTITION BY term ORDER BY p_partkey)::INT AS rank, p_partkey FROM x WHERE term <> '' QUALIFY rank <= 5"""


def client_keys(spark, d):
    """HMAC-SHA-256 of client and day under a fixed key, by day: distinct keys."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").cast("string").alias("u"))
    return e.groupBy("day").agg(F.countDistinct(hashing.hmac_sha256(b"inkwell", F.concat_ws(":", "day", "u"))).alias("clients"), F.min(hashing.hmac_sha256(b"inkwell", F.concat_ws(":", "day", "u"))).alias("least"))


def _padded(x: int) -> str:
    """The key of client_keys, filled with zeros to 64 bytes, each byte crossed with x; in hex."""
    return bytes(b ^ x for b in b"inkwell".ljust(64, b"\0")).hex()


CLIENT_KEYS = f"""WITH e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events),
k AS (SELECT day, sha256(unhex('{_padded(0x5C)}') || unhex(sha256(unhex('{_padded(0x36)}') || encode(day || ':' || user_id)))) AS key FROM e)
SELECT day, count(DISTINCT key) AS clients, min(key) AS least FROM k GROUP BY day"""


def alias_closure(spark, d):
    """Parts as aliases of the part of a third of their number, resolved to the end of the chain, with its length."""
    pairs = table(spark, d, "part").filter("p_partkey % 3 = 0 AND p_partkey > 0").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") / 3).cast("long").alias("alias_of"))
    return resolved(pairs, "name", "alias_of")


ALIASES = """WITH RECURSIVE c AS (SELECT p_partkey AS name, p_partkey // 3 AS target, 1 AS steps FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0
UNION ALL SELECT name, target // 3, steps + 1 FROM c WHERE target % 3 = 0 AND target > 0) SELECT name, min_by(target, -steps) AS target, max(steps)::INT AS steps FROM c GROUP BY name"""


def referenced_pages(spark, d):
    """Nodes reachable from node 1 over n -> 2n and n -> 2n + 1 within the parts."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("b"))
    edges = p.filter("b > 1").select(F.floor(F.col("b") / 2).cast("long").alias("a"), "b")
    return reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")))


REFERENCED = "WITH RECURSIVE r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = node AND p_partkey > 1) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"


def stanza_groups(spark, d):
    """Lines of each text joined between blank lines: number of groups, longest, digest of them in order."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    groups = F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("done"), F.lit(True).alias("cut")), lambda a, x: F.when(F.trim(x) == "", F.struct(a["done"].alias("done"), F.lit(True).alias("cut"))).otherwise(
        F.struct(F.when(a["cut"], F.array_append(a["done"], x)).otherwise(F.concat(F.slice(a["done"], 1, F.size(a["done"]) - 1), F.array(F.concat(F.element_at(a["done"], F.lit(-1)), x)))).alias("done"), F.lit(False).alias("cut"))))["done"]
    return table(spark, d, "documents").select("doc_id", groups.alias("g")).select("doc_id", F.size("g").cast("long").alias("groups"), F.coalesce(F.array_max(F.transform("g", lambda x: F.char_length(x))), F.lit(0)).alias("longest"), F.md5(F.array_join("g", "|")).alias("digest"))


STANZAS = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT *, trim(x) = '' AS blank, sum((trim(x) = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
s AS (SELECT doc_id, g, string_agg(x, '' ORDER BY i) AS t FROM n WHERE NOT blank GROUP BY ALL)
SELECT d.doc_id, count(t) AS groups, coalesce(max(length(t)), 0)::INT AS longest, md5(coalesce(string_agg(t, '|' ORDER BY g), '')) AS digest FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def tool_trace(spark, d):
    """Turns as a log: each user turn paired with the assistant turn after it, payload parsed where it is JSON."""
    c = table(spark, d, "conversations").withColumn("payload", F.concat(F.lit('{"n": '), F.char_length("text").cast("string"), F.when(F.col("turn") % 2 == 0, F.lit("}")).otherwise(F.lit(""))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("answer_role", F.lead("role").over(w)).withColumn("n", F.expr("try_variant_get(try_parse_json(payload), '$.n', 'int')"))
    return c.filter("role = 'user'").select("conv_id", "turn", "answer_role", "n")


TRACE = """SELECT conv_id, turn, answer_role, n FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS answer_role, CASE WHEN turn % 2 = 0 THEN length(text)::INT END AS n FROM conversations) WHERE role = 'user'"""


def ancestor_paths(spark, d):
    """Nearest common ancestor of neighbouring pages' URL paths: shared leading parts."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.split(F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1), "/").alias("parts"))
    w = Window.partitionBy("host").orderBy("page_id")
    q = p.withColumn("before", F.lag("parts").over(w)).filter("before IS NOT NULL")
    shared = F.aggregate(F.arrays_zip(F.col("parts").alias("a"), F.col("before").alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.when(s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False)), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))))["n"]
    return q.select("page_id", shared.alias("shared"))


ANCESTORS = r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, string_split(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/') AS parts FROM pages),
q AS (SELECT *, lag(parts) OVER (PARTITION BY host ORDER BY page_id) AS b FROM p)
SELECT page_id, coalesce(list_max(list_filter(range(1, 20), lambda n: n <= len(parts) AND n <= len(b) AND parts[1:n] = b[1:n])), 0)::INT AS shared FROM q WHERE b IS NOT NULL"""


def normalised_terms(spark, d):
    """Tokens after NFKC and lower case, with n-grams of ideographs: number and distinct number per language."""
    docs = table(spark, d, "documents").select("lang", hashing.nfkc(spark)(F.col("text")).alias("t"))
    w = F.explode(T.words(F.col("t"))).alias("w")
    return docs.select("lang", w).groupBy("lang", "w").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("terms"))


NORMALISED = "SELECT lang, count(*) AS tokens, count(DISTINCT w) AS terms FROM (SELECT lang, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[a-z0-9]+')) AS w FROM documents) GROUP BY lang"

QUERIES = {
    "lexicon_lookup": (lexicon_lookup, LEXICON), "client_keys": (client_keys, CLIENT_KEYS), "alias_closure": (alias_closure, ALIASES), "referenced_pages": (referenced_pages, REFERENCED), "stanza_groups": (stanza_groups, STANZAS),
    "tool_trace": (tool_trace, TRACE), "ancestor_paths": (ancestor_paths, ANCESTORS), "normalised_terms": (normalised_terms, NORMALISED),
    # Which lists lack a wanted item, and the best rank of it elsewhere.
    "list_diagnostics": sql("WITH r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rnk FROM lineitem), t AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS lists, min(rnk) AS best FROM r WHERE rnk <= 20 GROUP BY l_partkey) SELECT p_partkey, coalesce(lists, 0) AS lists, CAST(best AS BIGINT) AS best FROM part LEFT JOIN t ON l_partkey = p_partkey"),
    # Manifest against records: identities on one side only, and fields that differ.
    "record_audit": sql("WITH m AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE c_name END AS v FROM customer WHERE c_custkey % 5 <> 0) SELECT CASE WHEN m.k IS NULL THEN 'only_record' WHEN r.k IS NULL THEN 'only_manifest' WHEN m.v <> r.v THEN 'field' ELSE 'equal' END AS state, count(*) AS n FROM m FULL OUTER JOIN r ON m.k = r.k GROUP BY 1"),
    # Review decisions: conflicts within a sheet, and with what holds already.
    "review_sheet": sql("WITH s AS (SELECT o_custkey AS k, o_orderpriority AS v FROM orders), c AS (SELECT k, count(DISTINCT v) AS vs, min(v) AS v FROM s GROUP BY k) SELECT CASE WHEN vs > 1 THEN 'conflict' WHEN c_mktsegment = 'BUILDING' THEN 'held' ELSE 'new' END AS outcome, count(*) AS n FROM c JOIN customer ON c_custkey = k GROUP BY 1"),
    # Quote, offset and length of evidence against its paragraph.
    "quote_check": sql("SELECT doc_id, substr(text, 5, 20) = substr(text, 1 + 4, 20) AS exact, CAST(length(substr(text, 5, 20)) AS BIGINT) AS n, instr(text, substr(text, 5, 20)) = 5 AS first_place FROM documents"),
    # Groups keep the first value of one column and the ordered distinct values of another.
    "grouped_sites": sql("SELECT l_suppkey, l_returnflag, min(l_orderkey) AS first_order, count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY l_suppkey, l_returnflag"),
    # Coverage: first status that fits each event, counted.
    "coverage_status": sql("SELECT CASE WHEN event_type = 'purchase' AND value > 50 THEN 'handled' WHEN event_type = 'purchase' THEN 'excluded_small' WHEN props IS NULL THEN 'untracked' ELSE 'other' END AS state, count(*) AS n FROM events GROUP BY 1"),
    # Ready to go only if nothing stands against it.
    "preflight": sql("SELECT count(*) AS n, count(CASE WHEN text IS NULL OR text = '' THEN 1 END) AS blanks, count(DISTINCT doc_id) = count(*) AS unique_ids, count(*) > 0 AND count(CASE WHEN text IS NULL OR text = '' THEN 1 END) = 0 AS ready FROM documents"),
    # Finished cases are left out of a run that is taken up again.
    "resumed_run": sql("SELECT conv_id, count(*) AS turns FROM conversations WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = conversations.conv_id AND labels.quality = 1) GROUP BY conv_id"),
    # Labels by level and split.
    "level_pivot": sql("SELECT lang, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN quality = 0 THEN 1 END) AS bad, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic FROM documents JOIN labels ON labels.doc_id = documents.doc_id GROUP BY lang"),
    # One rule wins for each item and property: important, then specificity, then order.
    "cascade_winner": sql("SELECT p_brand, p_partkey, p_size FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE 'PROMO%' THEN 1 ELSE 0 END DESC, p_size DESC, p_partkey DESC) AS n FROM part) t WHERE n = 1"),
    # Ranks before and after a filter, with how many were filtered above.
    "raw_and_eligible_rank": sql("SELECT c_custkey, raw_rank, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY raw_rank) AS INT) AS eligible_rank FROM (SELECT c_custkey, c_mktsegment, c_acctbal, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS raw_rank FROM customer) t WHERE c_acctbal < 9000"),
    # A note's place in its text counts only if it occurs once.
    "unique_offsets": sql("SELECT doc_id, CAST(CASE WHEN length(text) - length(replace(text, 'that', '')) = 4 THEN instr(text, 'that') ELSE 0 END AS BIGINT) AS place FROM documents"),
    # Head rules: texts whose first line is short and ends without a mark.
    "heading_shape": sql("SELECT source, count(CASE WHEN instr(text, chr(10)) BETWEEN 2 AND 80 AND substr(text, instr(text, chr(10)) - 1, 1) NOT IN ('.', '!', '?') THEN 1 END) AS headed, count(*) AS n FROM documents GROUP BY source"),
    # Extensions: sets and cubes.
    "ext_set_operations": sql("SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) a UNION ALL SELECT 'first', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) b"),
    "ext_cube": sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
}
