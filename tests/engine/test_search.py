"""Exact search in a grid, inverted lists kept as tables, places, reranking, the stored index of terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import ivf, lexical
from inkwell.operators.ranking import placed, reranked
from inkwell.operators.vectors import exact_top_k


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(3).normal(size=(300, 8))
    return spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(x)], "id long, grp long, v array<double>").repartition(5)


@pytest.mark.parametrize("exclude", ["none", "self", "group"])
def test_grid_finds_what_one_block_finds(vectors, exclude):
    rows = lambda block: sorted(map(tuple, exact_top_k(vectors, vectors, 4, exclude, block).select("query_id", "rank", "vec_id", "score").collect()))
    one = rows(1000)
    assert len(one) == 1200 and rows(20) == one
    assert exact_top_k(vectors, vectors.limit(0), 4).count() == 0


def test_lists_are_kept(spark, vectors, tmp_path):
    lists = ivf.build(vectors, 6)
    ivf.save(lists, str(tmp_path / "lists"))
    again = ivf.load(spark, str(tmp_path / "lists"))
    q = vectors.filter("id % 20 = 0")
    rows = lambda l: sorted(map(tuple, ivf.search(l, q, 5, 3).select("query_id", "rank", "vec_id", "score").collect()))
    assert rows(lists) == rows(again)
    swept = {r["probes"]: r for r in ivf.sweep(again, q, exact_top_k(vectors, q, 5, "self"), 5, [1, 3, 3, 99, 0]).collect()}
    assert sorted(swept) == [1, 3, 6] and swept[6]["recall"] == 1.0 and swept[6]["wanted"] == 75
    assert swept[1]["recall"] <= swept[3]["recall"] <= 1.0
    spark.createDataFrame([(1, [0.0] * 8)], "cell int, centre array<double>").write.mode("overwrite").parquet(str(tmp_path / "lists" / "centres"))
    with pytest.raises(ValueError):
        ivf.load(spark, str(tmp_path / "lists"))


def test_placed(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r["k"] == r["place"] for r in placed(df, [F.col("k")]).collect())
    assert placed(df.limit(0), [F.col("k")]).count() == 0


def test_reranked(spark):
    rows = [("a", 1, "x", 0.1), ("a", 2, "y", 0.9), ("a", 3, "z", 0.9), ("b", 1, "x", 0.1), ("b", 2, "y", float("nan")), ("c", 1, "x", 0.1), ("c", 2, "y", None), ("d", 1, "x", 0.0), ("d", 2, "y", float("inf"))]
    got = reranked(spark.createDataFrame(rows, "q string, rank int, work_id string, s double"), ["q"], "s").orderBy("q", "final_rank").collect()
    assert [(r["q"], r["work_id"], r["reranked"]) for r in got[:3]] == [("a", "y", True), ("a", "z", True), ("a", "x", True)]
    assert [(r["q"], r["work_id"], r["reranked"]) for r in got[3:]] == [(q, w, False) for q in "bcd" for w in "xy"]


def test_stored_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red red dog"), (3, ""), (4, None), (5, "a fox, a dog")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red dog"), (2, "fox"), (3, "zebra"), (4, "")], "query_id long, text string")
    at = str(tmp_path / "terms")
    lexical.build(docs, "doc_id", T.words(F.col("text"))).save(at)
    index = lexical.load(spark, at)
    for flavour in ("plain", "fts"):
        got = lexical.search(index, q, T.words(F.col("text")), 3, flavour).select("query_id", "rank", "doc_id", "score").collect()
        want = lexical.bm25(docs, q, "doc_id", T.words(F.col("text")), T.words(F.col("text")), 3, flavour).select("query_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


@pytest.mark.parametrize("name", ["rrf_two_stage", "truncation_variants", "visible_targets", "metric_summary", "eligibility", "hybrid_search", "rank_contract", "rrf_fusion"])
def test_nothing_written_grows_with_texts(spark, tmp_path, monkeypatch, name):
    """All of 300 texts share a word with each question: what is written are lists of twenty, not a row for each text and question."""
    from inkwell import registry
    from inkwell.operators import lexical as L
    from inkwell.plans import evaluate_queries, search_queries
    from inkwell.sources import tables

    spark.createDataFrame([(i, f"the word w{i % 7} stands w{i % 11} here. And w{i} again", ("en", "fr")[i % 2], f"s{i % 3}", 9) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"the word w{i} stands") for i in range(4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(50)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    written = []

    def counted(df):
        out = tables.cut(df)
        written.append(out.count())
        return out

    for module in (L, search_queries, evaluate_queries):
        monkeypatch.setattr(module, "cut", counted)
    got = registry.QUERIES[name](spark, str(tmp_path)).count()
    assert got and max(written, default=0) <= 4 * 20 * 3


def test_best_of_each_task(spark):
    """The k best by tasks are those of all scores, with ties, null texts and keys that are no numbers; larger sets of questions go the other way."""
    import random

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, f"k{i:03}", None if i % 50 == 7 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(300)], "doc_id long, name string, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghz") for _ in range(3))) for i in range(12)] + [(99, "")], "query_id long, text string")
    words = T.words(F.col("text"))
    for key in ("doc_id", "name"):
        scores = lexical.bm25_scores(docs, q, key, words, words, ("plain", "fts"))
        want = {(f, *r) for f in ("plain", "fts") for r in lexical.best_scored(scores, key, f, 5).select("query_id", key, "score", "rank").collect()}
        for most in (1000, 2):
            got = lexical.bm25_best(docs, q, key, words, words, 5, ("plain", "fts"), max_broadcast=most)
            assert {(r["flavour"], r["query_id"], r[key], r["score"], r["rank"]) for r in got.collect()} == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_ahead_in_blocks(vectors):
    """Counts by blocks of questions are those of a loop, with ties; no pair is a row of a plan."""
    from inkwell.operators.vectors import ranks_ahead

    v = vectors.select("id", F.transform("v", lambda x: F.round(x, 0)).alias("v"))
    x = {r["id"]: np.array(r["v"]) for r in v.collect()}
    asked = [(i, x[i].tolist(), i + 1, float(x[i] @ x[i + 1])) for i in range(0, 290, 11)]
    out = ranks_ahead(v, v.sparkSession.createDataFrame(asked, "id long, v array<double>, probe_id long, probe_score double"), block=6)
    want = {(i, p, s, sum((float(x[i] @ x[o]), -o) > (s, -p) for o in x)) for i, _, p, s in asked}
    assert {tuple(r) for r in out.collect()} == want and "Join" not in _plan(out)



def test_cells_are_searched_by_matrices(vectors, monkeypatch):
    """The lists' answers in blocks of questions are those of all pairs of the probed cells; pairs are no rows of a plan."""
    from inkwell.operators.ranking import top_k_per_group
    from inkwell.sources.tables import cut

    lists = ivf.build(vectors, 6)
    lists.members = cut(lists.members)
    q = vectors.filter("id % 5 = 0")
    take = ivf.blocks_of
    monkeypatch.setattr(ivf, "blocks_of", lambda questions: take(questions, 9))
    names = ["query_id", "vec_id", "score", "rank"]
    every = ivf.probed(lists, q, 3).select("query_id", "vec_id", "score")
    want = {tuple(r) for r in top_k_per_group(every, ["query_id"], [F.desc("score"), F.col("vec_id")], 4).select(names).collect()}
    got = ivf.search(lists, q, 4, 3).select(names)
    assert {tuple(r) for r in got.collect()} == want and "Join" not in _plan(got)



def test_sweep_has_lists_of_k_alone(vectors, monkeypatch):
    """What a sweep hands on are the k best of each number of cells, as found over all pairs, without a question's own vector."""
    from inkwell.operators.ranking import top_k_per_group
    from inkwell.sources.tables import cut

    lists = ivf.build(vectors, 6)
    lists.members = cut(lists.members)
    q = vectors.filter("id % 5 = 0")
    monkeypatch.setattr(ivf, "probed", lambda *_: pytest.fail("pairs as rows"), raising=True)
    out = {r["probes"]: r for r in ivf.sweep(lists, q, exact_top_k(vectors, q, 4, "self"), 4, [1, 3, 6]).collect()}
    assert out[6]["found"] == out[6]["wanted"] == 4 * q.count() and 0 < out[1]["found"] <= out[3]["found"] <= out[6]["found"]
