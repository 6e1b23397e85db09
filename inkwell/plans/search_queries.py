"""Retrieval: lexical and dense channels, fusion, eligibility, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vector as V
from inkwell.operators import chronology as C
from inkwell.operators.lexical import bm25, bm25_best
from inkwell.operators.ranking import evidence, evenly_spaced, first_per_work, placed, renumbered, rrf, top_k_per_group
from inkwell.operators.vectors import exact_top_k, ranks_ahead
from inkwell.sources.tables import cut, table

#: Characters of evidence, words of a question's beginning, questions that are broadcast.
EVIDENCE, FIRST, MAX_BROADCAST = 40, 4, 100_000
KNOWN = [label for group in C.TOY_STARTS for label in group]


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _bm25(spark, d, k: int, flavour: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return bm25(docs, _questions(spark, d), "doc_id", T.words(F.col("text")), T.words(F.col("question")), k, flavour).select("query_id", "doc_id", "score", "rank")


def bm25_topk(spark, d):
    return _bm25(spark, d, 5, "plain")


def bm25_fts(spark, d):
    return _bm25(spark, d, 10, "fts")


def bm25_sql(k: int, flavour: str, name: str = "bm25_hits") -> str:
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))" if flavour == "plain" else "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
    return rf"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
 st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
 sc AS (SELECT query_id, doc_id, round(sum({idf} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
 {name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


BM25_TOPK = "WITH " + bm25_sql(5, "plain") + " SELECT * FROM bm25_hits"
BM25_FTS = "WITH " + bm25_sql(10, "fts") + " SELECT * FROM bm25_hits"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))


def dense_topk(spark, d):
    v = _vectors(spark, d)
    return exact_top_k(v, v.filter("id % 20 = 0"), 20).select("query_id", "vec_id", "score", "rank")


def dense_topk_filtered(spark, d):
    """The same within an allow-list of labels; the filter comes before the scan."""
    v = _vectors(spark, d)
    return exact_top_k(v.filter(F.col("grp").isin(1, 3, 5)), v.filter("id % 20 = 0"), 20, "self").select("query_id", "vec_id", "score", "rank")


def cross_label_neighbours(spark, d):
    """The five nearest vectors of another label, for every vector."""
    v = _vectors(spark, d)
    return exact_top_k(v, v, 5, "group").select("query_id", "vec_id", "score", "rank")


def dense_sql(k: int, where: str, q: str = "vec_id % 20 = 0", name: str = "dense") -> str:
    return f"""{name} AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
 FROM embeddings q, embeddings e WHERE q.{q} AND {where} QUALIFY rank <= {k})"""


DENSE = "WITH " + dense_sql(20, "true") + " SELECT * FROM dense"
DENSE_FILTERED = "WITH " + dense_sql(20, "e.label IN (1, 3, 5) AND e.vec_id <> q.vec_id") + " SELECT * FROM dense"
CROSS = "WITH " + dense_sql(5, "e.label <> q.label", "vec_id >= 0") + " SELECT * FROM dense"


def vector_checks(spark, d):
    """Counts of sound vectors, mean self-product, rows per label."""
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.sound(F.col("embedding"), 64)).alias("sound"), F.round(F.avg(V.norm(V.normalised(F.col("embedding")))), 6).alias("unit"), F.round(F.avg(V.dot(F.col("embedding"), F.reverse("embedding"))), 6).alias("reversed"))


VECTOR_CHECKS = """SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 3e-4) AS sound,
round(avg(sqrt(list_inner_product(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))))), 6) AS unit, round(avg(list_inner_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))), 6) AS reversed FROM embeddings GROUP BY label"""


def probe_ranks(spark, d):
    """Rank of the vector after each question's own in the question's full order, by counting what is ahead: nothing is sorted."""
    v = _vectors(spark, d)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = q.withColumn("id", F.col("query_id") + 1).join(v, "id").select("query_id", "q", F.col("id").alias("probe_id"), F.round(V.dot(F.col("q"), F.col("v")), 6).alias("probe_score"))
    asked = near.select(F.col("query_id").alias("id"), F.col("q").alias("v"), "probe_id", "probe_score")
    return ranks_ahead(v, asked).select(F.col("id").alias("query_id"), "probe_id", "probe_score", (F.col("ahead") + 1).alias("probe_rank"))


PROBE_RANKS = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id AS probe_id, score AS probe_score, rank AS probe_rank FROM r WHERE id = query_id + 1"""


def even_sample(spark, d):
    """Vectors at evenly spaced places of the order of ids."""
    e = table(spark, d, "embeddings")
    places = evenly_spaced(50, e.count())
    return placed(e.select("vec_id"), [F.col("vec_id")]).filter(F.col("place").isin(places))


EVEN_SAMPLE = """WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, place FROM n WHERE place IN (SELECT (i * (SELECT max(n) - 1 FROM n)) // 49 FROM range(50) t(i))"""


def _dense(spark, d) -> DataFrame:
    """The vectors nearest to each question's among those of documents; the vector whose id is the question's stands in for its encoding."""
    v = _vectors(spark, d)
    q = v.join(_questions(spark, d).select(F.col("query_id").alias("id")), "id", "left_semi")
    have = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return exact_top_k(v.join(have, "id", "left_semi"), q, 20).select("query_id", F.col("vec_id").alias("work_id"), "rank")


def _channels(spark, d) -> DataFrame:
    """Two lexical channels and a dense one with contiguous ranks: query_id, channel, rank, work_id, text (the work's beginning). A written
    table, so that the parts of a plan share one search."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lexical = bm25_best(docs, _questions(spark, d), "doc_id", T.words(F.col("text")), T.words(F.col("question")), 20, ("plain", "fts")).withColumnRenamed("doc_id", "work_id")
    lexical = lexical.withColumn("channel", F.when(F.col("flavour") == "plain", "bm25").otherwise("fts"))
    lists = [lexical, _dense(spark, d).withColumn("channel", F.lit("dense"))]
    hits = cut(reduce(DataFrame.unionByName, [h.select("query_id", "channel", "rank", "work_id") for h in lists]))
    # The texts of the hits alone are looked at, and no text is shuffled where the hits are few.
    met = _few(hits).join(docs.withColumnRenamed("doc_id", "work_id"), "work_id")
    return cut(met.select("query_id", "channel", "rank", "work_id", F.substring(T.collapse(F.col("text")), 1, EVIDENCE).alias("text")))


def _few(df: DataFrame) -> DataFrame:
    """df, a table, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _lexical_sql() -> str:
    a, b = bm25_sql(20, "plain", "h1"), bm25_sql(20, "fts", "h2")
    b = b[b.index(" sc AS") :].replace(" sc AS", "sc2 AS").replace("FROM sc ", "FROM sc2 ")
    return f"{a}, {b}, lexical AS (SELECT query_id, 'bm25' AS channel, rank, doc_id AS work_id FROM h1 UNION ALL SELECT query_id, 'fts', rank, doc_id FROM h2)"


def _channels_sql() -> str:
    dense = dense_sql(20, "e.vec_id IN (SELECT doc_id FROM documents)", "vec_id IN (SELECT item_id FROM benchmark)", "h3")
    return f"""{_lexical_sql()}, {dense}, ranked AS (SELECT * FROM lexical UNION ALL SELECT query_id, 'dense', rank, vec_id FROM h3),
 hits AS (SELECT ranked.*, substr({COLLAPSED.format('text')}, 1, {EVIDENCE}) AS text FROM ranked JOIN documents ON doc_id = work_id)"""


def rrf_fusion(spark, d):
    return rrf(_channels(spark, d), ["query_id"], ["channel"], limit=20)


def rrf_sql(source: str, limit: str = "") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best_rank, work_id)::INT AS rank FROM
 (SELECT query_id, work_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, min(rank)::INT AS best_rank, count(*) AS support FROM {source} GROUP BY ALL) {limit}"""


RRF = "WITH " + _channels_sql() + f" {rrf_sql('hits', 'QUALIFY rank <= 20')}"


def channel_overlap(spark, d):
    """Hits of each channel, works found by both, share of the shorter list."""
    h = _channels(spark, d)
    per = h.groupBy("query_id").agg(F.collect_set(F.when(F.col("channel") == "bm25", F.col("work_id"))).alias("a"), F.collect_set(F.when(F.col("channel") == "fts", F.col("work_id"))).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return per.select("query_id", F.size("a").cast("long").alias("n_bm25"), F.size("b").cast("long").alias("n_fts"), both.cast("long").alias("n_both"), F.round(both / F.least(F.size("a"), F.size("b")), 4).alias("share"))


OVERLAP = "WITH " + _channels_sql() + """, per AS (SELECT query_id, count(*) FILTER (channel = 'bm25') AS n_bm25, count(*) FILTER (channel = 'fts') AS n_fts, count(*) FILTER (channel <> 'dense') - count(DISTINCT work_id) FILTER (channel <> 'dense') AS n_both FROM hits GROUP BY 1)
SELECT *, round(n_both / least(n_bm25, n_fts), 4) AS share FROM per"""


def rrf_two_stage(spark, d):
    """Sentences of a question are questions of their own; each is fused and cut at 10, then their ranks are fused."""
    q = table(spark, d, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("part", "s")).select(F.concat_ws(":", "item_id", "part").alias("query_id"), F.col("s.text").alias("question"), "item_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    lists = bm25_best(docs, q, "doc_id", T.words(F.col("text")), T.words(F.col("question")), 20, ("plain", "fts")).select("query_id", F.col("doc_id").alias("work_id"), "rank", F.col("flavour").alias("channel"))
    inner = rrf(lists, ["query_id"], ["channel"], limit=10).select(F.split("query_id", ":")[0].cast("long").alias("item_id"), F.col("query_id").alias("part"), "work_id", "rank")
    return rrf(inner, ["item_id"], ["part"], limit=5)


def _two_stage_sql() -> str:
    base = _lexical_sql()
    from inkwell.plans.text_queries import SENTENCE_SQL, chunk_sql

    cut = chunk_sql(SENTENCE_SQL, ".!?").replace("documents", "benchmark").replace("doc_id", "item_id").replace(" p AS", " bp AS").replace("FROM p)", "FROM bp)")
    base = base.replace("SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark", "SELECT DISTINCT item_id || ':' || chunk_index AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM k")
    return f"""WITH {cut}, {base}, inr AS ({rrf_sql('lexical', 'QUALIFY rank <= 10')}), i2 AS (SELECT split_part(query_id, ':', 1)::BIGINT AS query_id, work_id, rank FROM inr)
SELECT query_id AS item_id, * EXCLUDE (query_id) FROM ({rrf_sql('i2', 'QUALIFY rank <= 5')})"""


TWO_STAGE = _two_stage_sql()


def _self_alias(spark, d) -> DataFrame:
    """Each question's own works: those that hold all its words in a row, whatever the white space.

    Documents give the hashes of their runs of up to FIRST words, for the lengths that the questions' beginnings have, and
    meet these by an equi-join; what meets is compared in full. Questions without words have no works.
    """
    norm = lambda c: T.collapse(F.col(c))
    run = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    q = _questions(spark, d).select("query_id", norm("question").alias("asked")).filter("asked <> ''").withColumn("w", F.split("asked", " ")).withColumn("n", F.least(F.size("w"), F.lit(FIRST)))
    q = q.select("query_id", "asked", "n", run(F.col("w"), 1, F.col("n")).alias("h"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), norm("text").alias("text"))
    sizes = sorted(r[0] for r in q.select("n").distinct().collect())  # FIRST numbers at most
    if not sizes:
        return q.join(docs, F.lit(False)).select("query_id", "work_id")

    def starts(n: int):
        all_ = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: run(F.col("w"), i, F.lit(n)))
        return F.when(F.size("w") >= n, all_).otherwise(F.array().cast("array<bigint>"))

    runs = map(starts, sizes)
    places = docs.select("work_id", F.split("text", " ").alias("w")).select("work_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("h"))
    hint = F.broadcast if q.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else lambda df: df
    met = cut(places.join(hint(q.select("query_id", "h")), "h").select("query_id", "work_id").distinct())
    full = _few(met).join(docs, "work_id").join(hint(q.select("query_id", "asked")), "query_id")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return full.filter(F.contains(pad("text"), pad("asked"))).select("query_id", "work_id")


def eligibility(spark, d):
    """Fused candidates with chronology status and reason of rejection; target: the language of the best candidate."""
    return _judged(spark, d, _channels(spark, d)).select("query_id", "work_id", "rank", "chronology_status", "reason")


def _judged(spark, d, hits: DataFrame) -> DataFrame:
    """The fused list of `hits`, 20 works a question, with chronology_status and reason. A written table."""
    fused = _few(cut(rrf(hits, ["query_id"], ["channel"], limit=20))).join(table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), "lang"), "work_id")
    target = fused.filter("rank = 1").select("query_id", F.col("lang").alias("target_lang"))
    own = _self_alias(spark, d).withColumn("is_self", F.lit(True))
    met = C.classified(fused.join(target, "query_id").join(own, ["query_id", "work_id"], "left"), "lang", "target_lang", C.lookup(spark, C.TOY_STARTS, C.TOY_OVERLAPS))
    return cut(met.withColumn("reason", C.rejection(F.coalesce("is_self", F.lit(False)))).select("query_id", "work_id", "rank", "rrf_score", "best_rank", "support", "chronology_status", "reason"))


def _eligible_sql() -> str:
    rel = ", ".join(f"('{a}', '{b}', '{s}')" for a, b, s, _ in C.relations(C.TOY_STARTS, C.TOY_OVERLAPS))
    return f"""{_channels_sql()}, fused AS ({rrf_sql('hits', 'QUALIFY rank <= 20')}), fl AS (SELECT f.*, lang FROM fused f JOIN documents ON doc_id = work_id),
 tg AS (SELECT query_id, lang AS target_lang FROM fl WHERE rank = 1), rel(lang, target_lang, status) AS (VALUES {rel}),
 own AS (SELECT item_id AS query_id, doc_id AS work_id, true AS is_self FROM (SELECT doc_id, {COLLAPSED.format('text')} AS t FROM documents) d, (SELECT item_id, {COLLAPSED.format('text')} AS probe FROM benchmark) b WHERE probe <> '' AND contains(' ' || d.t || ' ', ' ' || probe || ' ')),
 el AS (SELECT query_id, work_id, rank, best_rank, support, rrf_score, coalesce(status, 'unknown') AS chronology_status,
  CASE WHEN coalesce(is_self, false) THEN 'self_hit' WHEN status = 'clearly_later' THEN 'clearly_later' END AS reason
  FROM fl JOIN tg USING (query_id) LEFT JOIN rel USING (lang, target_lang) LEFT JOIN own USING (query_id, work_id))"""


ELIGIBILITY = "WITH " + _eligible_sql() + " SELECT query_id, work_id, rank, chronology_status, reason FROM el"


def hybrid_search(spark, d):
    """From questions to final ranks: lexical and dense channels, fusion, chronology and self hits, the best evidence, at most eight."""
    hits = _channels(spark, d)
    kept = _judged(spark, d, hits).filter("reason IS NULL").drop("reason").withColumnRenamed("rank", "fused_rank")
    final = renumbered(kept, ["query_id"], "fused_rank").filter("rank <= 8")
    best = evidence(first_per_work(hits, ["query_id", "channel"]), ["query_id"])
    return final.join(best, ["query_id", "work_id"]).select("query_id", "rank", "work_id", "rrf_score", "best_rank", "support", "chronology_status", "evidence_channel", "evidence_rank", "evidence_text")


HYBRID = "WITH " + _eligible_sql() + """, ev AS (SELECT query_id, work_id, min(struct_pack(r := rank, c := channel, t := text)) AS e FROM hits GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, work_id, rrf_score, best_rank, support, chronology_status, e.c AS evidence_channel, e.r AS evidence_rank, e.t AS evidence_text
FROM el JOIN ev USING (query_id, work_id) WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY el.rank) <= 8"""


def prefilter_ab(spark, d):
    """Filtering before fusion against after it: works in the first five of either arm, and in both."""
    hits = _channels(spark, d)
    judged = _judged(spark, d, hits)
    gone = judged.filter("reason IS NOT NULL").select("query_id", "work_id")
    before = rrf(renumbered(hits.join(gone, ["query_id", "work_id"], "left_anti").withColumnRenamed("rank", "raw"), ["query_id", "channel"], "raw"), ["query_id"], ["channel"], limit=5)
    after = renumbered(judged.filter("reason IS NULL").withColumnRenamed("rank", "raw"), ["query_id"], "raw").filter("rank <= 5")
    arms = before.select("query_id", "work_id", F.lit("before").alias("arm")).unionByName(after.select("query_id", "work_id", F.lit("after").alias("arm")))
    return arms.groupBy("query_id").agg(F.count_if(F.col("arm") == "before").alias("n_before"), F.count_if(F.col("arm") == "after").alias("n_after"), (F.count("*") - F.countDistinct("work_id")).alias("n_both"))


PREFILTER = "WITH " + _eligible_sql() + f""", gone AS (SELECT query_id, work_id FROM el WHERE reason IS NOT NULL),
fh AS (SELECT query_id, channel, work_id, row_number() OVER (PARTITION BY query_id, channel ORDER BY rank) AS rank FROM hits ANTI JOIN gone USING (query_id, work_id)),
b AS ({rrf_sql('fh', 'QUALIFY rank <= 5')}), a AS (SELECT query_id, work_id FROM fused ANTI JOIN gone USING (query_id, work_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5),
u AS (SELECT query_id, work_id, 'before' AS arm FROM b UNION ALL SELECT query_id, work_id, 'after' FROM a)
SELECT query_id, count(*) FILTER (arm = 'before') AS n_before, count(*) FILTER (arm = 'after') AS n_after, count(*) - count(DISTINCT work_id) AS n_both FROM u GROUP BY 1"""


def target_label(spark, d):
    """Label of each source: the given one, else the majority of its works' known labels, else unknown."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    most = C.dominant(docs, ["source"], "lang", KNOWN)
    given = docs.groupBy("source").agg(F.min(F.when(F.col("doc_id") % 7 == 0, F.col("lang"))).alias("given"), F.countDistinct("lang").alias("labels"))
    met = given.withColumn("given", F.when(F.col("labels") < 4, F.col("given"))).join(most, "source", "left")
    return met.select("source", F.coalesce("given", "dominant", F.lit("unknown")).alias("label"), F.when(F.col("given").isNotNull(), "request").when(F.col("dominant").isNotNull(), "majority").otherwise("unknown").alias("label_source"))


TARGET_LABEL = """WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IN ('en', 'fr', 'de', 'es') GROUP BY ALL),
m AS (SELECT source, CASE WHEN count(*) = 1 THEN min(lang) END AS dominant FROM (SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY source)) GROUP BY source),
g AS (SELECT source, CASE WHEN count(DISTINCT lang) < 4 THEN min(lang) FILTER (doc_id % 7 = 0) END AS given FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, coalesce(given, dominant, 'unknown') AS label, CASE WHEN given IS NOT NULL THEN 'request' WHEN dominant IS NOT NULL THEN 'majority' ELSE 'unknown' END AS label_source FROM g LEFT JOIN m USING (source)"""


def _gold(spark, d) -> DataFrame:
    return _self_alias(spark, d).withColumnRenamed("work_id", "gold")


def grade_cases(spark, d):
    """hit@5, all gold@5, recall@5 and reciprocal rank of each question with gold works, against its fused list."""
    fused = rrf(_channels(spark, d), ["query_id"], ["channel"], limit=20)
    gold = _gold(spark, d)
    met = gold.join(fused.withColumnRenamed("work_id", "gold"), ["query_id", "gold"], "left")
    g = met.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count_if(F.col("rank") <= 5).alias("found5"), F.min("rank").alias("first_rank"))
    return g.select("query_id", "n_gold", (F.col("found5") > 0).alias("hit5"), (F.col("found5") == F.col("n_gold")).alias("all5"), F.round(F.col("found5") / F.col("n_gold"), 4).alias("recall5"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 4).alias("rr"))


GRADE = "WITH " + _eligible_sql() + """, g AS (SELECT query_id, count(*) AS n_gold, count(*) FILTER (rank <= 5) AS found5, min(rank) AS first_rank FROM own LEFT JOIN fused USING (query_id, work_id) GROUP BY 1)
SELECT query_id, n_gold, found5 > 0 AS hit5, found5 = n_gold AS all5, round(found5 / n_gold, 4) AS recall5, round(coalesce(1.0 / first_rank, 0.0), 4) AS rr FROM g"""


def metric_summary(spark, d):
    """Mean metrics over the graded questions."""
    return grade_cases(spark, d).agg(F.count("*").alias("cases"), F.round(F.avg(F.col("hit5").cast("int")), 4).alias("hit5"), F.round(F.avg(F.col("all5").cast("int")), 4).alias("all5"), F.round(F.avg("recall5"), 4).alias("recall5"), F.round(F.avg("rr"), 4).alias("mrr"))


SUMMARY = f"SELECT count(*) AS cases, round(avg(hit5::INT), 4) AS hit5, round(avg(all5::INT), 4) AS all5, round(avg(recall5), 4) AS recall5, round(avg(rr), 4) AS mrr FROM ({GRADE})"


def outcome_buckets(spark, d):
    """Two arms (the lexical flavours) compared by where the first gold work lies: counts by bucket."""
    gold = _gold(spark, d)
    best = lambda ch: F.min(F.when(F.col("channel") == ch, F.col("rank")))
    met = gold.join(_channels(spark, d).withColumnRenamed("work_id", "gold"), ["query_id", "gold"], "left").groupBy("query_id").agg(best("bm25").alias("a"), best("fts").alias("b"))
    far = lambda c: F.coalesce(c, F.lit(99))
    a, b = far(F.col("a")), far(F.col("b"))
    bucket = (
        F.when((a <= 5) & (b <= 5) & (a == b), "both_same").when((a <= 5) & (b <= 5) & (a < b), "both_first_better").when((a <= 5) & (b <= 5), "both_second_better").when(a <= 5, "only_first")
        .when(b <= 5, "only_second").when((a <= 20) & (b <= 20), "both_late").when((a <= 20) | (b <= 20), "one_late").otherwise("none")
    )
    return met.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


OUTCOME = "WITH " + _eligible_sql() + """, m AS (SELECT query_id, coalesce(min(rank) FILTER (channel = 'bm25'), 99) AS a, coalesce(min(rank) FILTER (channel = 'fts'), 99) AS b FROM own LEFT JOIN hits USING (query_id, work_id) GROUP BY 1)
SELECT CASE WHEN a <= 5 AND b <= 5 AND a = b THEN 'both_same' WHEN a <= 5 AND b <= 5 AND a < b THEN 'both_first_better' WHEN a <= 5 AND b <= 5 THEN 'both_second_better' WHEN a <= 5 THEN 'only_first'
WHEN b <= 5 THEN 'only_second' WHEN a <= 20 AND b <= 20 THEN 'both_late' WHEN a <= 20 OR b <= 20 THEN 'one_late' ELSE 'none' END AS bucket, count(*) AS n FROM m GROUP BY 1"""


def rank_contract(spark, d):
    """Lists whose ranks are not 1 to n: there must be none; with the number of lists checked."""
    h = _channels(spark, d).groupBy("query_id", "channel").agg(F.count("*").alias("n"), F.max("rank").alias("hi"), F.min("rank").alias("lo"), F.countDistinct("rank").alias("u"))
    return h.agg(F.count("*").alias("lists"), F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("u") != F.col("n"))).alias("broken"))


RANK_CONTRACT = "WITH " + _channels_sql() + ", g AS (SELECT query_id, channel, count(*) AS n, max(rank) AS hi, min(rank) AS lo FROM hits GROUP BY ALL) SELECT count(*) AS lists, count(*) FILTER (lo <> 1 OR hi <> n) AS broken FROM g"


def document_search(spark, d):
    """Search within a hierarchy: BM25 over parts with their brand, each type a question (named by its first part), cut to five with a truncated text."""
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"))
    q = table(spark, d, "part").groupBy(F.col("p_type").alias("question")).agg(F.min("p_partkey").alias("query_id"))
    hits = bm25(parts, q, "p_partkey", T.words(F.col("text")), T.words(F.col("question")), 5)
    return hits.join(parts, "p_partkey").select("query_id", "rank", "p_partkey", "score", F.substring("text", 1, 12).alias("text"), (F.char_length("text") > 12).alias("truncated"))


def _document_sql() -> str:
    s = bm25_sql(5, "plain").replace("documents", "parts").replace("doc_id", "p_partkey").replace("item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark", "query_id, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS term FROM (SELECT p_type, min(p_partkey) AS query_id FROM part GROUP BY p_type)")
    return f"WITH parts AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS text FROM part), {s} SELECT query_id, rank, p_partkey, score, substr(text, 1, 12) AS text, length(text) > 12 AS truncated FROM bm25_hits JOIN parts USING (p_partkey)"


QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK), "bm25_fts": (bm25_fts, BM25_FTS), "dense_topk": (dense_topk, DENSE), "dense_topk_filtered": (dense_topk_filtered, DENSE_FILTERED),
    "cross_label_neighbours": (cross_label_neighbours, CROSS), "vector_checks": (vector_checks, VECTOR_CHECKS), "probe_ranks": (probe_ranks, PROBE_RANKS), "even_sample": (even_sample, EVEN_SAMPLE),
    "rrf_fusion": (rrf_fusion, RRF), "channel_overlap": (channel_overlap, OVERLAP), "rrf_two_stage": (rrf_two_stage, TWO_STAGE), "eligibility": (eligibility, ELIGIBILITY), "hybrid_search": (hybrid_search, HYBRID),
    "prefilter_ab": (prefilter_ab, PREFILTER), "target_label": (target_label, TARGET_LABEL), "grade_cases": (grade_cases, GRADE), "metric_summary": (metric_summary, SUMMARY), "outcome_buckets": (outcome_buckets, OUTCOME),
    "rank_contract": (rank_contract, RANK_CONTRACT), "document_search": (document_search, _document_sql()),
}
