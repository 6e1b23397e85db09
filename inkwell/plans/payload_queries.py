"""Payloads, evidence, permitted items and links.

The tables have no nested payload but that of events, so an order with its lines is packed as the JSON text of a provider and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import payload as P
from inkwell.sources.tables import table


def _orders(spark, d) -> DataFrame:
    """o_orderkey, o_orderpriority, lines: the lines of each order, by number."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"))).alias("lines"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _references(spark, d) -> DataFrame:
    ref = lambda l: F.struct(F.when(l["l_quantity"] < 40, F.concat(F.lit("part "), l["l_partkey"].cast("string"))).alias("Clause"), l["l_linestatus"].alias("Title"), F.lit("F").alias("Dynasty"), l["l_suppkey"].alias("WritingId"))
    sentence = lambda l: F.struct(F.when(l["l_returnflag"] != "N", l["l_returnflag"]).alias("Clause"), F.array(ref(l)).alias("References"))
    packed = _orders(spark, d).select("o_orderkey", "o_orderpriority", F.to_json(F.struct(F.transform("lines", sentence).alias("Sentences"))).alias("payload"))
    return P.references(packed, "o_orderkey", "o_orderpriority", "payload")


def _allusions(spark, d) -> DataFrame:
    entry = lambda l: F.struct(F.when(l["l_returnflag"] == "R", F.array(F.struct(l["l_partkey"].cast("string").alias("Explain")))).alias("Explains"), F.when(l["l_linestatus"] == "F", F.array(F.struct(l["l_suppkey"].cast("string").alias("Content"), l["l_returnflag"].alias("Book")))).alias("Quotes"))
    packed = _orders(spark, d).select("o_orderkey", "o_orderpriority", F.to_json(F.transform("lines", entry)).alias("payload"))
    return P.allusions(packed, "o_orderkey", "o_orderpriority", "payload")


def evidence_rows(spark, d):
    """Evidence of two providers in one schema, by order and kind."""
    every = P.evidence({"references": _references(spark, d), "allusions": _allusions(spark, d)}, "o_orderkey")
    return every.select("o_orderkey", "provider", "anchor", "type", "text", "title", F.col("metadata")["writing_id"].alias("writing_id"))


EVIDENCE_ROWS = """WITH l AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, 'references' AS provider, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE o_orderpriority END AS anchor, 'reference' AS type, 'part ' || l_partkey AS text, l_linestatus AS title, l_suppkey::VARCHAR AS writing_id FROM l WHERE l_quantity < 40
UNION ALL SELECT o_orderkey, 'allusions', o_orderpriority, 'allusion', concat_ws(chr(10), CASE WHEN l_returnflag = 'R' THEN 'meaning: ' || l_partkey END, CASE WHEN l_linestatus = 'F' THEN 'quote: ' || l_suppkey END), CASE WHEN l_linestatus = 'F' THEN l_returnflag END, NULL
FROM l WHERE l_returnflag = 'R' OR l_linestatus = 'F'"""


def category_members(spark, d):
    """Categories of an order's payload: parts of open lines as its own, of other lines as a group's; whether part 7 is among them."""
    char = lambda l: F.struct(l["l_partkey"].cast("string").alias("Char"))
    own, rest = F.transform(F.filter("lines", lambda l: l["l_linestatus"] == "O"), char), F.transform(F.filter("lines", lambda l: l["l_linestatus"] != "O"), char)
    one = F.struct(F.lit("1").alias("Id"), F.col("o_orderpriority").alias("Name"), own.alias("Chars"), F.array(F.struct(F.lit("g").alias("Id"), rest.alias("Chars"))).alias("PingShuiCategories"))
    packed = _orders(spark, d).select("o_orderkey", F.to_json(F.struct(F.array(one).alias("Categories"))).alias("payload"))
    return P.categories(packed, "o_orderkey", "payload", F.lit("7"), 3).select("o_orderkey", "name", "n", F.array_join("sample", ",").alias("sample"), "present")


CATEGORY_MEMBERS = """WITH l AS (SELECT o_orderkey, o_orderpriority, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linestatus <> 'O', l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, any_value(o_orderpriority) AS name, count(*)::INT AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS sample, bool_or(l_partkey = 7) AS present FROM l GROUP BY o_orderkey"""


def unique_names(spark, d):
    """Each part name and each of its words as a question: a part with that name, or alias (its last word), is found if it is the only one."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lower("p_name"), F.col("p_size").cast("string")).alias("name"), F.array(F.concat_ws(" ", F.lower("p_brand"), F.element_at(F.split("p_name", " "), -1))).alias("aliases"))
    # Names of parts of size 50, which some parts have and others do not.
    asked = table(spark, d, "part").select(F.explode(F.array(F.concat_ws(" ", F.lower("p_name"), F.lit("50")), F.concat_ws(" ", F.lower("p_brand"), F.element_at(F.split("p_name", " "), -1)))).alias("asked")).distinct()
    return P.unique_name(parts, asked).select("asked", "n", "status", "id", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"))


UNIQUE_NAMES = """WITH p AS (SELECT p_partkey AS id, lower(p_name) || ' ' || p_size AS name, lower(p_brand) || ' ' || string_split(p_name, ' ')[-1] AS alias, lower(p_name) || ' 50' AS q FROM part),
n AS (SELECT DISTINCT id, unnest([name, alias]) AS asked FROM p), a AS (SELECT DISTINCT unnest([q, alias]) AS asked FROM p),
m AS (SELECT a.asked, id, count(id) OVER (PARTITION BY a.asked) AS n, row_number() OVER (PARTITION BY a.asked ORDER BY id) AS i FROM a LEFT JOIN n USING (asked))
SELECT asked, any_value(n) AS n, CASE any_value(n) WHEN 0 THEN 'no_hit' WHEN 1 THEN 'ok' ELSE 'candidates' END AS status, CASE WHEN any_value(n) = 1 THEN min(id) END AS id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (i <= 7), '') AS candidates FROM m GROUP BY asked"""


def permitted_items(spark, d):
    """Purchases of an item (`k` of the payload) that a click or view of the same user had shown before, by user."""
    e = table(spark, d, "events").select("user_id", "ts", "event_type", F.from_json("props", "struct<k:bigint>")["k"].alias("item"))
    r = P.permitted(e.filter("event_type = 'purchase'"), e.filter("event_type IN ('click', 'view')"), ["user_id"], "item", "ts")
    return r.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("permitted").alias("permitted"))


PERMITTED_ITEMS = """WITH e AS (SELECT user_id, ts, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events)
SELECT user_id, count(*) AS requests, count(*) FILTER (EXISTS (SELECT 1 FROM e s WHERE s.user_id = r.user_id AND s.item = r.item AND s.event_type IN ('click', 'view') AND s.ts < r.ts)) AS permitted FROM e r WHERE event_type = 'purchase' GROUP BY user_id"""


def unified_records(spark, d):
    """Orders as records of two generations (shipped lines as methods, open ones as moves) in the schema of the later one."""
    method = lambda l: F.struct(l["l_returnflag"].alias("code"), l["l_linestatus"].alias("argument_path"), F.array(F.struct(l["l_linenumber"].alias("paragraph"), l["l_partkey"].cast("string").alias("quote"), l["l_suppkey"].alias("char_start"))).alias("evidence"))
    move = lambda l: F.struct(l["l_returnflag"].alias("method_code"), l["l_linestatus"].alias("analysis"), l["l_linenumber"].alias("paragraph"), l["l_partkey"].cast("string").alias("exact_quote"), l["l_suppkey"].alias("char_start"))
    r = _orders(spark, d).select("o_orderkey", F.transform(F.filter("lines", lambda l: l["l_linestatus"] == "F"), method).alias("methods"), F.transform(F.filter("lines", lambda l: l["l_linestatus"] == "O"), move).alias("moves"))
    methods, origin = P.unified(F.col("methods"), F.col("moves"))
    r = r.select("o_orderkey", origin.alias("origin"), methods.alias("m"))
    evidences = F.aggregate("m", F.lit(0), lambda a, x: a + F.size(x["evidence"]))
    return r.select("o_orderkey", "origin", F.when(F.col("m").isNotNull(), F.size("m")).alias("methods"), evidences.alias("evidence"), F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["code"], x["evidence"][0]["quote"])), ",").alias("codes"))


UNIFIED_RECORDS = """WITH l AS (SELECT o_orderkey, bool_or(l_linestatus = 'F') AND bool_or(l_linestatus = 'O') AS both_kinds, bool_or(l_linestatus = 'F') AS f, count(*)::INT AS n, string_agg(l_returnflag || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) AS codes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN both_kinds THEN 'ambiguous' WHEN f THEN 'later' ELSE 'earlier' END AS origin, CASE WHEN NOT both_kinds THEN n END AS methods, CASE WHEN NOT both_kinds THEN n END AS evidence, CASE WHEN NOT both_kinds THEN codes END AS codes FROM l"""


def page_links(spark, d):
    """The first five distinct links of each page that start with a lower-case letter, in the order of the page."""
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "url"))
    return P.ordered_urls(links, ["page_id"], [F.col("place")], "url", F.col("url").rlike("^/[a-z]")).select("page_id", "rank", "url")


PAGE_LINKS = """WITH l AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages)),
f AS (SELECT page_id, url, min(place) AS place FROM l WHERE regexp_matches(url, '^/[a-z]') GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place)::INT AS rank, url FROM f QUALIFY rank <= 5"""


QUERIES = {
    "evidence_rows": (evidence_rows, EVIDENCE_ROWS), "category_members": (category_members, CATEGORY_MEMBERS), "unique_names": (unique_names, UNIQUE_NAMES),
    "permitted_items": (permitted_items, PERMITTED_ITEMS), "unified_records": (unified_records, UNIFIED_RECORDS), "page_links": (page_links, PAGE_LINKS),
}
