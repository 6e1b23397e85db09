"""Retrieval as it is judged: stored indexes, truncation, reranking, what a reader sees, clusters, templates of markup."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vector as V
from inkwell.operators import ivf, lexical, templates
from inkwell.operators.ranking import reranked, rrf, top_k_per_group
from inkwell.operators.vectors import exact_top_k
from inkwell.plans import search_queries as S
from inkwell.sources import shards
from inkwell.sources.markup import blocks
from inkwell.sources.tables import cut, shared_dir, table

#: Sizes of clusterings, dimensions kept, largest lists of cells that are probed.
CLUSTERS, DIMENSIONS, PROBES = (8, 16, 24), 50, [1, 2, 4, 8, 16]
#: Works that a reader is shown, and their columns.
SHOWN, PUBLIC = 8, ["query_id", "rank", "work_id", "excerpt"]


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/inkwell/{uuid.uuid4().hex}"


def stored_search(spark, d):
    """An index of the parts' names by n-grams of two and three characters, stored and loaded; each name is a question."""
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"))
    at = _folder(spark)
    lexical.build(parts, "p_partkey", T.ngrams(F.lower("text"))).save(at)
    shards.sign(spark, at, shards.corpus_facts(parts) | {"terms": "ngrams 2 to 3"} | {f"rows:{t}": spark.read.parquet(f"{at}/{t}").count() for t in ("postings", "terms", "totals")})
    q = table(spark, d, "part").groupBy(F.col("p_name").alias("question")).agg(F.min("p_partkey").alias("query_id"))
    shards.gate(spark, {"parts": at}, shards.corpus_facts(parts) | {"terms": "ngrams 2 to 3"})
    return lexical.search(lexical.load(spark, at), q, T.ngrams(F.lower("question")), 10, "fts").select("query_id", "rank", "p_partkey", "score")


def _grams_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, substr(r, i::INT, n::INT) AS term FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS r FROM {source}), range(2, 4) g(n), range(1, 100) p(i) WHERE i + n - 1 <= length(r)"""


STORED = f"""WITH docs AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS text FROM part), asked AS (SELECT p_name AS text, min(p_partkey) AS query_id FROM part GROUP BY 1),
g AS ({_grams_sql('docs', 'p_partkey')}), q AS (SELECT DISTINCT * FROM ({_grams_sql('asked', 'query_id')})), dl AS (SELECT p_partkey, count(*) AS dl FROM g GROUP BY 1), st AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT count(*) FROM g) / (SELECT count(*) FROM docs) AS avgdl),
tf AS (SELECT p_partkey, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, p_partkey, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN dl USING (p_partkey) JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey)::INT AS rank, p_partkey, score FROM sc WHERE score > 0 QUALIFY rank <= 10"""


def truncation_variants(spark, d):
    """Sentences of a question are fused by channel, then with each other: with each list cut at ten in between, and uncut. Works in the first five of either."""
    q = table(spark, d, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("part", "s")).select(F.concat_ws(":", "item_id", "part").alias("query_id"), F.col("s.text").alias("question"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    lists = lexical.bm25_best(docs, q, "doc_id", T.words(F.col("text")), T.words(F.col("question")), 20, ("plain", "fts")).select("query_id", F.col("doc_id").alias("work_id"), "rank", F.col("flavour").alias("channel"))
    inner = cut(rrf(lists, ["query_id"], ["channel"]).select(F.split("query_id", ":")[0].cast("long").alias("item_id"), F.col("query_id").alias("part"), "work_id", "rank"))
    arm = lambda hits, name: rrf(hits, ["item_id"], ["part"], limit=5).select("item_id", "work_id", F.col("rank").alias(name))
    return arm(inner.filter("rank <= 10"), "rank_cut").join(arm(inner, "rank_late"), ["item_id", "work_id"], "full_outer")


def _truncation_sql() -> str:
    base = S.TWO_STAGE
    head = base[: base.index("inr AS")]
    arm = lambda name, where: f"{name}_in AS (SELECT split_part(query_id, ':', 1)::BIGINT AS query_id, work_id, rank FROM inr {where}), {name} AS ({S.rrf_sql(name + '_in', 'QUALIFY rank <= 5')})"
    return f"""{head} inr AS ({S.rrf_sql('lexical')}), {arm('a', 'WHERE rank <= 10')}, {arm('b', '')}
SELECT query_id AS item_id, work_id, a.rank AS rank_cut, b.rank AS rank_late FROM a FULL JOIN b USING (query_id, work_id)"""


def rerank_fallback(spark, d):
    """Search hits reranked by the share of the question's distinct words that the text begins with; the scorer has no number for texts
    under 200 characters, and a list with one of these keeps its order."""
    hits = S.bm25_fts(spark, d).withColumnRenamed("doc_id", "work_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), "text")
    q = S._questions(spark, d)
    asked = F.array_distinct(T.words(F.col("question")))
    share = F.size(F.array_intersect(asked, F.slice(T.words(F.col("text")), 1, 50))) / F.size(asked)
    score = F.when(F.char_length("text") < 200, F.lit(float("nan"))).otherwise(F.round(share, 6))
    scored = hits.join(docs, "work_id").join(q, "query_id").select("query_id", "work_id", "rank", score.alias("relevance"))
    return reranked(scored, ["query_id"], "relevance").select("query_id", "work_id", "rank", "final_rank", "reranked")


RERANK = "WITH " + S.bm25_sql(10, "fts") + r""", r AS (SELECT h.query_id, h.doc_id AS work_id, h.rank, CASE WHEN length(d.text) >= 200 THEN round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+')[1:50])) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 6) END AS s
 FROM bm25_hits h JOIN documents d ON d.doc_id = h.doc_id JOIN benchmark b ON b.item_id = h.query_id), f AS (SELECT *, count(s) OVER (PARTITION BY query_id) = count(*) OVER (PARTITION BY query_id) AS reranked FROM r)
SELECT query_id, work_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN -s ELSE 0 END, rank)::INT AS final_rank, reranked FROM f"""


def _shown(spark, d, fused: DataFrame) -> DataFrame:
    """What a reader is shown of a fused list: the first works under the public columns only, no scores and no ranks of channels."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), "text")
    met = S._few(cut(fused.filter(F.col("rank") <= SHOWN))).join(docs, "work_id")
    return met.withColumn("excerpt", F.substring(T.collapse(F.col("text")), 1, S.EVIDENCE)).select(*PUBLIC)


def visible_targets(spark, d):
    """Questions with gold works: how many of these a reader is shown, and the rank of the first."""
    fused = rrf(S._channels(spark, d), ["query_id"], ["channel"], limit=20)
    gold = S._self_alias(spark, d)
    met = gold.join(_shown(spark, d, fused), ["query_id", "work_id"], "left")
    return met.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count("rank").alias("n_visible"), F.min("rank").alias("first_rank"))


VISIBLE = "WITH " + S._eligible_sql() + f" SELECT query_id, count(*) AS n_gold, count(rank) AS n_visible, min(rank) AS first_rank FROM own LEFT JOIN (SELECT query_id, work_id, rank FROM fused WHERE rank <= {SHOWN}) USING (query_id, work_id) GROUP BY 1"


def held_candidates(spark, d):
    """Among a question's first eight works, those of one source of which the longer holds the whole of the shorter; the best-ranked holder of each."""
    fused = rrf(S._channels(spark, d), ["query_id"], ["channel"], limit=8)
    docs = table(spark, d, "documents").filter("source IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("work_id"), "source", F.col("text"))
    c = cut(fused.select("query_id", "work_id", "rank").join(docs, "work_id"))  # eight rows a question
    inner, outer = c.toDF("work_id", "query_id", "rank", "source", "text"), c.toDF("held_by", "query_id", "outer_rank", "source", "outer_text")
    met = inner.join(outer, ["query_id", "source"]).filter((F.col("work_id") != F.col("held_by")) & (F.char_length("outer_text") > F.char_length("text")) & F.contains("outer_text", F.col("text")))
    return top_k_per_group(met, ["query_id", "work_id"], [F.col("outer_rank")], 1, "n").select("query_id", "work_id", "rank", "held_by", "outer_rank")


HELD = "WITH " + S._channels_sql() + f""", fused AS ({S.rrf_sql('hits', 'QUALIFY rank <= 8')}), c AS (SELECT query_id, work_id, rank, source, text FROM fused JOIN documents ON doc_id = work_id)
SELECT a.query_id, a.work_id, a.rank, b.work_id AS held_by, b.rank AS outer_rank FROM c a JOIN c b ON a.query_id = b.query_id AND a.source = b.source AND a.work_id <> b.work_id AND length(b.text) > length(a.text) AND a.text <> '' AND contains(b.text, a.text)
QUALIFY row_number() OVER (PARTITION BY a.query_id, a.work_id ORDER BY b.rank) = 1"""


def probe_summary(spark, d):
    """Vectors that any question found: how many found them, the best rank, its question and score."""
    hits = S.dense_topk(spark, d)
    best = F.min(F.struct("rank", "query_id", "score"))
    return hits.groupBy("vec_id").agg(F.count("*").alias("n"), best.alias("b")).select("vec_id", "n", F.col("b.rank").alias("best_rank"), F.col("b.query_id").alias("best_query"), F.col("b.score").alias("best_score"))


PROBES_SQL = "WITH " + S.dense_sql(20, "true") + " SELECT vec_id, count(*) AS n, min(rank) AS best_rank, min_by(query_id, rank * 1000000000000 + query_id) AS best_query, min_by(score, rank * 1000000000000 + query_id) AS best_score FROM dense GROUP BY 1"


def attached_verdicts(spark, d):
    """Labels as verdicts on sampled documents (those in English): attached, or why not; documents without a verdict are open."""
    sample = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.lit(True).alias("sampled"))
    verdicts = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "keep").otherwise(F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("verdict"))
    met = sample.join(verdicts, "doc_id", "full_outer")
    state = F.when(F.col("sampled").isNull(), "not_sampled").when(F.col("verdict").isNull(), "open").when(F.col("verdict").isin("keep", "drop"), "attached").otherwise("bad_value")
    return met.groupBy(state.alias("state"), "verdict").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


VERDICTS = """WITH s AS (SELECT doc_id, true AS sampled FROM documents WHERE lang = 'en'), v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'keep' ELSE 'quality ' || quality END AS verdict FROM labels)
SELECT CASE WHEN sampled IS NULL THEN 'not_sampled' WHEN verdict IS NULL THEN 'open' WHEN verdict IN ('keep', 'drop') THEN 'attached' ELSE 'bad_value' END AS state, verdict, count(*) AS n, count(DISTINCT doc_id) AS documents FROM s FULL JOIN v USING (doc_id) GROUP BY ALL"""


def probe_sweep(spark, d):
    """Recall at 20 of stored inverted lists by the number of cells probed, over the vectors whose ids are divisible by 20."""
    v, at = S._vectors(spark, d), _folder(spark)
    ivf.save(ivf.build(v, 16), at)
    shards.sign(spark, at, shards.corpus_facts(v) | {f"rows:{t}": spark.read.parquet(f"{at}/{t}").count() for t in ("members", "centres")})
    shards.gate(spark, {"lists": at}, shards.corpus_facts(v))
    q = v.filter("id % 20 = 0")
    return ivf.sweep(ivf.load(spark, at), q, exact_top_k(v, q, 20, "self"), 20, PROBES)


def resumed_shards(spark, d):
    """Unit vectors written in shards of 100 ids by a run that ends after two shards and one that takes it up; what the shards hold."""
    v, at = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), _folder(spark)
    unit = lambda df: df.withColumn("v", V.normalised(F.col("v")))
    for most in (2, None):
        told = shards.write_shards(v, "vec_id", at, 100, {"form": "unit"}, unit, most)
    held = spark.read.parquet(f"{at}/data").groupBy(F.col("shard").cast("long").alias("shard")).agg(F.sum(F.size("v")).alias("entries"), F.round(F.sum(V.dot(F.col("v"), F.col("v"))), 4).alias("squares"))
    return told.join(held, "shard").select("shard", "first_row", "last_row", "rows", "entries", "squares")


SHARDS = """SELECT vec_id // 100 AS shard, min(vec_id) AS first_row, max(vec_id) AS last_row, count(*) AS "rows", sum(len(embedding))::BIGINT AS entries, round(count(*)::DOUBLE, 4) AS squares FROM embeddings GROUP BY ALL"""


def reduced_clusters(spark, d):
    """Vectors in 50 dimensions by principal components, clustered in three sizes: silhouette by cosine, smallest and largest cluster."""
    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    x = cut(PCA(k=DIMENSIONS, inputCol="raw", outputCol="features").fit(x).transform(x).select("vec_id", "features"))
    judge, rows = ClusteringEvaluator(distanceMeasure="cosine"), []
    for k in CLUSTERS:
        found = KMeans(k=k, seed=1, distanceMeasure="cosine").fit(x).transform(x)
        sizes = found.groupBy("prediction").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n")).first()
        rows.append((k, round(judge.evaluate(found), 4), *sizes))
    return spark.createDataFrame(rows, "clusters int, silhouette double, smallest long, largest long")


def block_templates(spark, d):
    """Templates of blocks over all pages: those most frequent, and all rare ones, with what stands beside them and samples."""
    return templates.kept(templates.catalogue(blocks(table(spark, d, "pages")), "page_id")).withColumn("samples", F.to_json("samples"))


def marker_changes(spark, d):
    """The first paragraph of each page that begins with a capital of A to Z before one that does not."""
    return templates.transitions(blocks(table(spark, d, "pages")), "page_id", r"^[A-Z]").select("page_id", "ordinal", "text", "next_text")


QUERIES = {
    "stored_search": (stored_search, STORED), "truncation_variants": (truncation_variants, _truncation_sql()), "rerank_fallback": (rerank_fallback, RERANK), "visible_targets": (visible_targets, VISIBLE),
    "held_candidates": (held_candidates, HELD), "probe_summary": (probe_summary, PROBES_SQL), "attached_verdicts": (attached_verdicts, VERDICTS), "probe_sweep": (probe_sweep, None), "resumed_shards": (resumed_shards, SHARDS),
    "reduced_clusters": (reduced_clusters, None), "block_templates": (block_templates, None), "marker_changes": (marker_changes, None),
}
