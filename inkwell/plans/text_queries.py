"""Queries over text units, terms, fingerprints and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.sources.tables import table

SENTENCE_SQL = r"""[^.!?]*[.!?]+["'')]*|[^.!?]+$"""
CLAUSE_SQL = r"""[^,;:.!?]*[,;:.!?]+["'')]*|[^,;:.!?]+$"""


def chunks(docs: DataFrame, policy: str, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, start, end, text of each sentence or clause."""
    cut = T.sentences if policy == "sentence" else T.clauses
    return docs.select(key, F.posexplode(cut(F.col("text"))).alias("chunk_index", "c")).select(key, "chunk_index", "c.start", "c.end", "c.text")


def sentence_chunks(spark, d):
    return chunks(table(spark, d, "documents"), "sentence")


def chunk_sql(pattern: str, ends: str) -> str:
    return rf"""
  p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS piece, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM documents),
  o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS s, trim(piece, E' \n\t\r') AS t FROM p),
  k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, s::INT AS start, (s + length(t))::INT AS "end", t AS text
        FROM o WHERE regexp_matches(t, '[^\s{ends}"'')]'))"""


SENTENCES = "WITH" + chunk_sql(SENTENCE_SQL, ".!?") + " SELECT * FROM k"


def chunk_report(spark, d):
    """Works, chunks, chunks a work, longest chunk, chunks over three sizes, works without chunks; by policy."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = None
    for policy, cut in (("sentence", T.sentences), ("clause", T.clauses)):
        sized = docs.select(F.transform(cut(F.col("text")), lambda x: F.char_length(x["text"])).alias("n"))
        over = lambda k: F.sum(F.size(F.filter("n", lambda x: x > k))).cast("long")
        one = sized.agg(F.count("*").alias("works"), F.sum(F.size("n")).cast("long").alias("chunks"), F.max(F.array_max("n")).alias("longest"), over(128).alias("over_128"), over(256).alias("over_256"), over(512).alias("over_512"), F.count_if(F.size("n") == 0).alias("empty_works"))
        one = one.withColumn("policy", F.lit(policy)).withColumn("per_work", F.round(F.col("chunks") / F.col("works"), 4))
        out = one if out is None else out.unionByName(one)
    return out


def _report_sql(policy: str, pattern: str, ends: str) -> str:
    return f"""SELECT '{policy}' AS policy, (SELECT count(*) FROM documents) AS works, count(*) AS chunks, max(length(text))::INT AS longest,
  count(*) FILTER (length(text) > 128) AS over_128, count(*) FILTER (length(text) > 256) AS over_256, count(*) FILTER (length(text) > 512) AS over_512,
  (SELECT count(*) FROM documents) - count(DISTINCT doc_id) AS empty_works, round(count(*) / (SELECT count(*) FROM documents), 4) AS per_work
  FROM (WITH{chunk_sql(pattern, ends)} SELECT * FROM k)"""


CHUNK_REPORT = _report_sql("sentence", SENTENCE_SQL, ".!?") + " UNION ALL " + _report_sql("clause", CLAUSE_SQL, ",;:.!?")


def char_ngrams_top(spark, d):
    """The 50 most frequent character 2- and 3-grams, with term and document frequency."""
    terms = table(spark, d, "documents").select("doc_id", F.explode(T.ngrams(F.col("text"))).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))
    return terms.groupBy("gram").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.desc("tf"), "gram").limit(50)


CHAR_NGRAMS = r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS run FROM documents),
g AS (SELECT doc_id, substr(run, i, n) AS gram FROM (SELECT doc_id, run, n, unnest(range(1, length(run) - n + 2)) AS i FROM r, (VALUES (2), (3)) v(n) WHERE length(run) >= n))
SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY gram ORDER BY tf DESC, gram LIMIT 50"""


def query_plan(spark, d):
    """Each question as distinct variants (whole, sentences, clauses) in order, with where they come from."""
    q = table(spark, d, "benchmark").filter(F.trim("text") != "")
    left = F.regexp_replace("text", r"^(?U)\s+", "")
    whole = F.regexp_replace(left, r"(?U)\s+$", "")
    begin = F.char_length("text") - F.char_length(left)
    spans = lambda c, level: F.transform(c, lambda x: F.struct(F.lit(level).alias("level"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    passage = F.array(F.struct(F.lit("passage").alias("level"), begin.alias("start"), (begin + F.char_length(whole)).alias("end"), whole.alias("text")))
    every = q.select("item_id", F.posexplode(F.concat(passage, spans(T.sentences(F.col("text")), "sentence"), spans(T.clauses(F.col("text")), "clause"))).alias("ord", "v"))
    grouped = every.groupBy("item_id", F.col("v.text").alias("text")).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("v.level").alias("level"), F.col("v.start").alias("start"), F.col("v.end").alias("end")))).alias("o"))
    origins = F.concat_ws(";", F.transform("o", lambda x: F.concat_ws(":", x["level"], x["start"].cast("string"), x["end"].cast("string"))))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("o")[0]["ord"]))
    return grouped.select("item_id", place.alias("variant"), "text", origins.alias("origins"))


def _spans_of(name: str, pattern: str, ends: str, rank: int) -> str:
    body = chunk_sql(pattern, ends).replace("documents", "bench").replace("doc_id", "item_id")
    return f"SELECT item_id, {rank} AS r, chunk_index AS i, '{name}' AS level, start, \"end\" AS e, text FROM (WITH{body} SELECT * FROM k)"


QUERY_PLAN = rf"""
WITH bench AS (SELECT item_id, text FROM benchmark WHERE trim(text) <> ''),
v AS (SELECT item_id, 0 AS r, 0 AS i, 'passage' AS level, (length(text) - length(regexp_replace(text, '^\s+', '')))::INT AS start,
        (length(text) - length(regexp_replace(text, '^\s+', '')) + length(trim(text, E' \n\t\r')))::INT AS e, trim(text, E' \n\t\r') AS text FROM bench
      UNION ALL {_spans_of('sentence', SENTENCE_SQL, '.!?', 1)} UNION ALL {_spans_of('clause', CLAUSE_SQL, ',;:.!?', 2)}),
g AS (SELECT item_id, text, min(struct_pack(r := r, i := i)) AS first, string_agg(level || ':' || start || ':' || e, ';' ORDER BY r, i) AS origins FROM v GROUP BY item_id, text)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY first)::INT AS variant, text, origins FROM g"""


def fingerprint_aliases(spark, d):
    """Works of one author with one fingerprint: size of each group of two or more, and its members."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    g = docs.groupBy("source", T.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return g.filter("n > 1")


FINGERPRINTS = r"""SELECT source, sha256(regexp_replace(text, '\s+', '', 'g')) AS fingerprint, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents WHERE source IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""


def exact_dup_groups(spark, d):
    """Records equal in all compared fields: each member with its group's hash and size."""
    docs = table(spark, d, "documents")
    key = F.sha2(F.concat_ws("\0", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    members = docs.select(key.alias("record_hash"), "doc_id")
    sizes = members.groupBy("record_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return members.join(sizes, "record_hash")


EXACT_DUPS = """SELECT record_hash, doc_id, n FROM (SELECT doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '')) AS record_hash, count(*) OVER (PARTITION BY coalesce(lang, ''), coalesce(text, '')) AS n FROM documents) WHERE n > 1"""


def text_features(spark, d):
    """Per language: how many texts show a feature, and the rate to four digits."""
    docs = table(spark, d, "documents")
    features = {"digits": r"[0-9]", "question": r"\?", "dollar": r"\$", "long_line": r"[^\n]{400}", "multi_line": r"\n"}
    cols = [c for name, p in features.items() for c in (F.count_if(F.col("text").rlike(p)).alias(name), F.round(F.count_if(F.col("text").rlike(p)) / F.count("*"), 4).alias(f"{name}_rate"))]
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(T.letters_only(F.col("text")))).alias("letters"), F.sum(F.size(T.runs(F.col("text")))).cast("long").alias("runs"), F.sum(T.unit_count(F.col("text"))).cast("long").alias("units"), *cols)


TEXT_FEATURES = r"""SELECT lang, count(*) AS n, sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')))::BIGINT AS letters, sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+')))::BIGINT AS runs,
sum(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')))::BIGINT AS units, """ + ", ".join(
    f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}, round(count(*) FILTER (regexp_matches(text, '{p}')) / count(*), 4) AS {n}_rate"
    for n, p in (("digits", "[0-9]"), ("question", r"\?"), ("dollar", r"\$"), ("long_line", r"[^\n]{400}"), ("multi_line", r"\n"))
) + " FROM documents GROUP BY lang"


def excerpts(spark, d):
    """Collapsed excerpt of each text, and a window around the first `the`."""
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), 60).alias("excerpt"), T.snippet(T.collapse(F.col("text")), F.lit("the"), 40).alias("snippet"))


EXCERPTS = r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT *, instr(t, 'the') AS pos FROM c),
b AS (SELECT *, CASE WHEN pos - 1 > 20 THEN pos - 11 ELSE 0 END AS s FROM p)
SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS excerpt,
CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, 40) || CASE WHEN s + 40 < length(t) THEN '…' ELSE '' END AS snippet FROM b"""


def letter_duplicates(spark, d):
    """Texts that are equal in letters and digits: the first of each group stays (by id)."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(T.letters_only(F.lower("text"))).alias("norm"))
    n = F.row_number().over(Window.partitionBy("norm").orderBy("doc_id"))
    return docs.withColumn("n", n).groupBy("norm").agg(F.min("doc_id").alias("kept_id"), (F.count("*") - 1).alias("dropped"))


LETTER_DUPS = r"SELECT md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS norm, min(doc_id) AS kept_id, count(*) - 1 AS dropped FROM documents GROUP BY 1"


def url_safety(spark, d):
    """Scheme, user info, port, address and host-suffix rules of each page's URL."""
    u = table(spark, d, "pages").select("page_id", "url")
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract("_a", r"^(?:[^@]*@)?([^:]*)", 1))
    out = u.withColumn("scheme", scheme).withColumn("_a", authority).withColumn("host", host)
    reason = (
        F.when(~F.col("scheme").isin("http", "https"), "scheme").when(F.contains("_a", F.lit("@")), "userinfo").when(F.col("_a").rlike(":[0-9]+$"), "port")
        .when(F.col("host").rlike(r"^[0-9.]+$"), "address").when((F.col("host") == "example.com") | F.endswith("host", F.lit(".example.com")), "suffix")
    )
    return out.select("page_id", "scheme", "host", F.coalesce(reason, F.lit("ok")).alias("verdict"))


URL_SAFETY = r"""WITH a AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS a FROM pages),
h AS (SELECT *, lower(regexp_extract(a, '^(?:[^@]*@)?([^:]*)', 1)) AS host FROM a)
SELECT page_id, scheme, host, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(a, '@') THEN 'userinfo' WHEN regexp_matches(a, ':[0-9]+$') THEN 'port'
WHEN regexp_matches(host, '^[0-9.]+$') THEN 'address' WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'suffix' ELSE 'ok' END AS verdict FROM h"""


def host_pages(spark, d):
    """Per host: pages, distinct paths without query, titles that repeat."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), (F.count("*") - F.countDistinct("title")).alias("repeated_titles"))


HOST_PAGES = r"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n, count(DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) AS paths,
count(*) - count(DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1)) AS repeated_titles FROM pages GROUP BY 1"""


def markup_text(spark, d):
    """Paragraph texts of each page with tags stripped: number, and digest of all in order."""
    paras = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    return table(spark, d, "pages").select("page_id", F.size(paras).cast("long").alias("paragraphs"), F.md5(F.array_join(paras, "\n")).alias("digest"))


MARKUP = r"""SELECT page_id, len(p)::BIGINT AS paragraphs, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT page_id,
list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS p FROM pages)"""


def citation_check(spark, d):
    """Numbers in square brackets of each user turn, and those beyond the turns so far."""
    c = table(spark, d, "conversations")
    made = F.concat(F.lit("see ["), (F.col("turn") + 1).cast("string"), F.lit("] and ["), (F.col("turn") * 2).cast("string"), F.lit("], ["), (F.col("turn") + 1).cast("string"), F.lit("]"))
    ids = T.citations(F.concat("text", made))
    return c.select("conv_id", "turn", F.array_join(ids, ",").alias("cited"), F.array_join(F.array_except(ids, F.sequence(F.lit(1), F.col("turn").cast("int") + 1)), ",").alias("invalid"))


CITATIONS = r"""WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || 'see [' || (turn + 1) || '] and [' || (turn * 2) || '], [' || (turn + 1) || ']', '\[(\d+)\]', 1), lambda x: x::INT))) AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(ids, ',') AS cited, array_to_string(list_filter(ids, lambda x: x < 1 OR x > turn + 1), ',') AS invalid FROM c"""


def keyword_in_context(spark, d):
    """Up to five occurrences of a marker in each document, with 16 characters on both sides."""
    hits = F.regexp_extract_all("text", F.lit(r"[^\n]{0,16} the [^\n]{0,16}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(hits, 1, 5)).alias("n", "context"))


KWIC = r"""SELECT doc_id, (i - 1)::INT AS n, x[i] AS context FROM (SELECT doc_id, x, unnest(range(1, least(len(x), 5) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]{0,16} the [^\n]{0,16}') AS x FROM documents))"""

QUERIES = {
    "sentence_chunks": (sentence_chunks, SENTENCES), "chunk_report": (chunk_report, CHUNK_REPORT), "char_ngrams_top": (char_ngrams_top, CHAR_NGRAMS), "query_plan": (query_plan, QUERY_PLAN),
    "fingerprint_aliases": (fingerprint_aliases, FINGERPRINTS), "exact_dup_groups": (exact_dup_groups, EXACT_DUPS), "text_features": (text_features, TEXT_FEATURES), "excerpts": (excerpts, EXCERPTS),
    "letter_duplicates": (letter_duplicates, LETTER_DUPS), "url_safety": (url_safety, URL_SAFETY), "host_pages": (host_pages, HOST_PAGES), "markup_text": (markup_text, MARKUP),
    "citation_check": (citation_check, CITATIONS), "keyword_in_context": (keyword_in_context, KWIC),
}
