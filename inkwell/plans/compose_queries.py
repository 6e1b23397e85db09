"""Composition, containment, markup blocks and clustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import compose
from inkwell.operators.ivf import build, search
from inkwell.operators.vectors import exact_top_k
from inkwell.sources.markup import blocks
from inkwell.sources.tables import cut, table, works


def _sentences(spark, d) -> DataFrame:
    """doc_id, author, i, s: every sentence of documents with an author, from 1."""
    return works(spark, d).filter("author IS NOT NULL").select(F.col("work_id").alias("doc_id"), "author", F.posexplode(T.sentence_texts(F.col("content"))).alias("i", "s")).withColumn("i", F.col("i") + 1)


def _works(spark, d) -> DataFrame:
    """Works of two kinds: each sentence of 24 characters or more (`doc:i`), and for each document the concatenation of them all (`doc`)."""
    # Written, as both kinds are made from the sentences, each more than once.
    docs = cut(works(spark, d).filter("author IS NOT NULL").select("work_id", "author", F.filter(T.sentence_texts(F.col("content")), lambda x: F.char_length(x) >= compose.MIN_PIECE).alias("s")))
    members = docs.select("author", F.posexplode("s").alias("i", "content"), "work_id").select(F.concat_ws(":", F.col("work_id"), F.col("i") + 1).alias("work_id"), "author", "content")
    return members.union(docs.select(F.col("work_id").cast("string"), "author", F.array_join("s", "").alias("content")))


def _documents_as_hosts(spark, d) -> DataFrame:
    """Whole documents as hosts (`doc`) beside their sentences as works (`doc:i`), repeated texts of an author once."""
    s = _sentences(spark, d).groupBy("author", "s").agg(F.min(F.struct("doc_id", "i")).alias("k")).select(F.concat_ws(":", "k.doc_id", "k.i").alias("work_id"), "author", F.col("s").alias("content"))
    return s.union(works(spark, d).filter("author IS NOT NULL").select(F.col("work_id").cast("string"), "author", "content"))


def _edges(cover: DataFrame) -> DataFrame:
    return cover.select(F.col("host").alias("parent_work_id"), F.col("member").alias("member_work_id"), "member_order")


def concat_cover(spark, d):
    """Hosts that are a concatenation: number of parts, and whether validation of the edges agrees."""
    all_works = _works(spark, d)
    good = compose.validated_edges(_edges(compose.covers(all_works)), all_works)
    return good.groupBy("parent_work_id").agg(F.count("*").alias("parts"), F.every("valid").alias("valid"), F.max("end").alias("end"))


def cover_sql(pieces: str, hosts: str, name: str) -> str:
    """Reachable ends from 0, the first predecessor (place, member) of each, and the walk back, as recursive SQL over `pieces` and `hosts`."""
    return f"""{name}_p AS (SELECT work_id AS member, author, content AS piece, length(content) AS n, left(content, 12) AS k FROM {pieces} WHERE length(content) >= 24),
{name}_h AS (SELECT work_id AS host, author, content, length(content) AS len FROM {hosts} WHERE length(content) >= 48),
{name}_r AS (SELECT host, author, content, len, 0::BIGINT AS pos, 0::BIGINT AS was, NULL::VARCHAR AS member FROM {name}_h
 UNION SELECT r.host, r.author, r.content, r.len, r.pos + p.n, r.pos, p.member FROM {name}_r r JOIN {name}_p p ON p.author = r.author AND p.k = substring(r.content, r.pos + 1, 12) AND substring(r.content, r.pos + 1, p.n) = p.piece WHERE p.n < r.len),
{name}_b AS (SELECT host, len, pos, was, member FROM {name}_r WHERE member IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host, pos ORDER BY was, member) = 1),
{name}_w AS (SELECT host, pos, was, member FROM {name}_b WHERE pos = len UNION ALL SELECT w.host, b.pos, b.was, b.member FROM {name}_w w JOIN {name}_b b ON b.host = w.host AND b.pos = w.was)"""


SENTENCES_SQL = r"""sl AS (SELECT doc_id, source AS author, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]+["'')]*|[^.!?]+$'), lambda x: trim(x, E' \n\t\r')), lambda x: regexp_matches(x, '[^\s.!?"'')]')) AS s FROM documents WHERE source IS NOT NULL)"""
WORKS_SQL = f"""{SENTENCES_SQL}, lo AS (SELECT doc_id, author, list_filter(s, lambda x: length(x) >= 24) AS s FROM sl),
w AS (SELECT doc_id || ':' || generate_subscripts(s, 1) AS work_id, author, unnest(s) AS content FROM lo UNION ALL SELECT doc_id::VARCHAR, author, array_to_string(s, '') FROM lo)"""
COVER = f"""WITH RECURSIVE {WORKS_SQL}, {cover_sql("w", "w", "c")} SELECT host AS parent_work_id, count(*) AS parts, true AS valid, max(pos) AS "end" FROM c_w GROUP BY host HAVING count(*) >= 2"""


def normalised_cover(spark, d):
    """Documents whose letters and digits are a concatenation of those of sentences of their author; documents that are one as they stand are left out."""
    return compose.normalised_covers(cut(_documents_as_hosts(spark, d))).groupBy("host").agg(F.count("*").alias("parts"), F.max("end").alias("end"))


HOSTS_SQL = f"""{SENTENCES_SQL}, u AS (SELECT doc_id, author, generate_subscripts(s, 1) AS i, unnest(s) AS content FROM sl),
w AS (SELECT arg_min(doc_id || ':' || i, (doc_id, i)) AS work_id, author, content FROM u GROUP BY author, content UNION ALL SELECT doc_id::VARCHAR, author, text FROM sl)"""
NORMALISED = rf"""WITH RECURSIVE {HOSTS_SQL}, m AS (SELECT work_id, author, regexp_replace(nfc_normalize(content), '[^\p{{L}}\p{{N}}]', '', 'g') AS content FROM w), {cover_sql("m", "m", "c")}, {cover_sql("w", "w", "e")}
SELECT host, count(*) AS parts, max(pos) AS "end" FROM c_w WHERE host NOT IN (SELECT host FROM e_w GROUP BY host HAVING count(*) >= 2) GROUP BY host HAVING count(*) >= 2"""


def partial_cover(spark, d):
    """Documents of which sentences of their author cover eight tenths or more, walked from the left."""
    return compose.greedy_cover(cut(_documents_as_hosts(spark, d))).groupBy("host").agg(F.count("*").alias("parts"), F.first("coverage").alias("coverage"), F.sum(F.col("end") - F.col("start")).alias("covered"))


PARTIAL = f"""WITH RECURSIVE {HOSTS_SQL}, p AS (SELECT author, work_id AS member, content AS piece, length(content) AS n, left(content, 12) AS k FROM w WHERE length(content) >= 24),
h AS (SELECT author, work_id AS host, content, length(content) AS len FROM w WHERE length(content) >= 48), x AS (SELECT author, host, content, len, unnest(range(0, len - 11)) AS pos FROM h),
o AS (SELECT host, len, pos, pos + n AS e FROM x JOIN p ON p.author = x.author AND p.k = substring(content, pos + 1, 12) AND substring(content, pos + 1, n) = piece WHERE n < len),
b AS (SELECT host, len, pos, max(e) AS e FROM o GROUP BY ALL), nx AS (SELECT b.host, b.pos, b.e, b.len, n.pos AS then_pos FROM b ASOF LEFT JOIN b n ON b.host = n.host AND b.e <= n.pos),
k AS (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY host ORDER BY pos) = 1 UNION ALL SELECT n.* FROM k JOIN nx n ON n.host = k.host AND n.pos = k.then_pos)
SELECT host, count(*) AS parts, round(sum(e - pos) / max(len), 4) AS coverage, sum(e - pos)::BIGINT AS covered FROM k GROUP BY host HAVING count(*) >= 2 AND sum(e - pos) / max(len) >= 0.8"""


def containment_kinds(spark, d):
    """Documents that hold a benchmark item, as it stands, by its letters, or within three edits: pairs by kind."""
    items, docs = table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    met = compose.containing(docs, items, "doc_id", "item_id").join(docs, "doc_id").join(items.withColumnRenamed("text", "part"), "item_id")
    return compose.containment(met.select(F.concat_ws(":", "doc_id", "item_id").alias("id"), "text", "part")).filter("kind <> 'none'").groupBy("kind").agg(F.count("*").alias("n"))


# Near: a segment of an item (four, each of a quarter of its letters) stands in the text; around it, the least distance of the item to the substrings that begin and end within three letters of its place.
KINDS = r"""WITH d AS MATERIALIZED (SELECT doc_id, text, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS t FROM documents), i AS MATERIALIZED (SELECT item_id, text AS part, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS p FROM benchmark),
c AS (SELECT doc_id, item_id, t, p, CASE WHEN length(part) >= 24 AND contains(text, part) THEN 'exact' WHEN length(p) >= 24 AND contains(t, p) THEN 'normalized' WHEN length(p) >= 40 THEN 'open' ELSE 'none' END AS kind FROM d, i WHERE p <> ''),
s AS (SELECT doc_id, item_id, t, p, unnest([0, 1, 2, 3]) AS k FROM c WHERE kind = 'open'), q AS (SELECT *, length(p) * k // 4 AS off, substr(p, length(p) * k // 4 + 1, length(p) * (k + 1) // 4 - length(p) * k // 4) AS seg FROM s),
o AS (SELECT *, string_split(t, seg) AS l FROM q WHERE contains(t, seg)), u AS (SELECT *, unnest(range(1, len(l))) AS n FROM o), w AS (SELECT doc_id, item_id, t, p, list_sum(list_transform(l[1:n], lambda x: length(x))) + (n - 1) * length(seg) - off AS place FROM u),
g AS (SELECT doc_id, item_id, t, p, place + unnest(range(-3, 4)) AS b FROM w), h AS (SELECT *, length(p) + unnest(range(-3, 4)) AS m FROM g WHERE b >= 0),
near AS (SELECT DISTINCT doc_id, item_id FROM h WHERE levenshtein(substr(t, b::BIGINT + 1, m::BIGINT), p) <= 3)
SELECT kind, count(*) AS n FROM (SELECT kind FROM c WHERE kind IN ('exact', 'normalized') UNION ALL SELECT 'near' FROM near) GROUP BY kind"""


def suppressed_candidates(spark, d):
    """For each document its first sentence of 24 characters as the question, and as candidates the collection it is in and all its sentences:
    the collection goes, as a candidate's hit or the question itself (an alias of its own work) is a member of it."""
    w = _works(spark, d)
    parent = F.split_part("work_id", F.lit(":"), F.lit(1))
    edges = w.filter(F.col("work_id").contains(":")).select(parent.alias("parent_work_id"), F.col("work_id").alias("member_work_id"))
    first = w.filter(F.col("work_id").endswith(":1")).select(parent.alias("query_id"), F.col("work_id").alias("alias"), F.col("content").alias("current"))
    # The collection and the members that are not the question; by kind, then by number.
    place = F.when(F.col("work_id").contains(":"), F.split_part("work_id", F.lit(":"), F.lit(2)).cast("int")).otherwise(F.lit(0))
    cand = w.select(parent.alias("query_id"), "work_id", F.col("content").alias("text"), place.alias("place")).filter("place <> 1").join(first, "query_id")
    cand = cand.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return compose.composition_filter(cand.select("query_id", "rank", "work_id", "text", "current"), edges, first.select("query_id", "alias"), "current", 8).select("query_id", "rank", "work_id")


SUPPRESSED = rf"""WITH {WORKS_SQL}, f AS (SELECT split_part(work_id, ':', 1) AS q, content AS cur FROM w WHERE ends_with(work_id, ':1')),
c AS (SELECT q, work_id, content, cur, CASE WHEN contains(work_id, ':') THEN split_part(work_id, ':', 2)::INT ELSE 0 END AS place FROM w JOIN f ON q = split_part(work_id, ':', 1) WHERE NOT ends_with(work_id, ':1')),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place) AS n FROM c), z AS (SELECT q, work_id, place, regexp_replace(content, '\s+', '', 'g') AS t, regexp_replace(cur, '\s+', '', 'g') AS u FROM r WHERE n <= 32),
gone AS (SELECT q FROM z a WHERE place = 0 AND (contains(t, u) OR contains(u, t) OR EXISTS (SELECT 1 FROM z b WHERE b.q = a.q AND b.place > 0 AND contains(a.t, b.t))))
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY place)::INT AS rank, work_id FROM z WHERE NOT (place = 0 AND q IN (SELECT q FROM gone)) QUALIFY rank <= 8"""


def html_blocks(spark, d):
    """Blocks of each page in order: headings and paragraphs with their text, counted by tag."""
    return blocks(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag").startswith("h")).alias("headings"), F.sum(F.char_length("text")).alias("chars"))


def block_sections(spark, d):
    """Each paragraph under the heading before it, and the tags on both sides."""
    b = blocks(table(spark, d, "pages"))
    w = Window.partitionBy("page_id").orderBy("ordinal")
    return b.select("page_id", "ordinal", "tag", F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(w).alias("heading"), F.lag("tag").over(w).alias("before"), F.lead("tag").over(w).alias("after"))


# A block ends at its own closing tag or where the next one begins. The named characters of the tables' pages.
NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
PLAIN_SQL = reduce(lambda t, n: f"replace({t}, '{n[0]}', '{n[1]}')", NAMED, "t")
BLOCKS_SQL = r"""x AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?s)<(?:script|style|nav)\b.*?</(?:script|style|nav)>|<!--.*?-->', '', 'g'), '<(h[1-6]|p|li|td)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM pages),
y AS (SELECT page_id, string_split(unnest(l[2:]), chr(2)) AS m, generate_subscripts(l[2:], 1) AS i FROM x), z AS (SELECT page_id, i, m[1] AS tag, regexp_replace(string_split(m[2], '</' || m[1] || '>')[1], '<[^>]*>', '', 'g') AS t FROM y),
u AS (SELECT page_id, i, tag, trim(regexp_replace(@plain, '\s+', ' ', 'g')) AS text FROM z),
b AS (SELECT page_id, tag, text, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ordinal FROM u WHERE text <> '')""".replace("@plain", PLAIN_SQL)
HTML_BLOCKS = f"WITH {BLOCKS_SQL} SELECT page_id, count(*) AS n, count(*) FILTER (tag = 'p') AS paragraphs, count(*) FILTER (starts_with(tag, 'h')) AS headings, sum(length(text))::BIGINT AS chars FROM b GROUP BY page_id"
BLOCK_SECTIONS = f"""WITH {BLOCKS_SQL} SELECT page_id, ordinal, tag, last_value(CASE WHEN starts_with(tag, 'h') THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS heading,
lag(tag) OVER w AS before, lead(tag) OVER w AS after FROM b WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)"""


def ivf_recall(spark, d):
    """Recall at 20 of the inverted lists against the exact scan, over the vectors whose ids are divisible by 20."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.filter("id % 20 = 0")
    near = search(build(v, 16), q, 20, probes=8)
    true = exact_top_k(v, q, 20)
    return near.select("query_id", "vec_id").intersect(true.select("query_id", "vec_id")).groupBy("query_id").agg(F.round(F.count("*") / 20, 2).alias("recall"))


def clusters(spark, d):
    """Vectors by cluster (k = 8): size, most frequent labels."""
    index = build(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("v")), 8)
    g = index.members.groupBy("cell", "grp").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("n"), "grp"))).filter("place <= 3")


QUERIES = {
    "concat_cover": (concat_cover, COVER), "normalised_cover": (normalised_cover, NORMALISED), "partial_cover": (partial_cover, PARTIAL), "containment_kinds": (containment_kinds, KINDS), "suppressed_candidates": (suppressed_candidates, SUPPRESSED), "html_blocks": (html_blocks, HTML_BLOCKS),
    "block_sections": (block_sections, BLOCK_SECTIONS), "ivf_recall": (ivf_recall, None), "clusters": (clusters, None),
}
