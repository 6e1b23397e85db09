"""Golden values of the text functions, ranks, labels and state."""

import hashlib
from collections import deque

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vector as V
from inkwell.operators import chronology as C
from inkwell.operators import compose
from inkwell.operators.ranking import evenly_spaced, rrf
from inkwell.streaming.quota import admitted


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_sentences_with_offsets(spark):
    text = "  “第一句？！”\n第二句；还没结束。  尾巴  "
    got = one(spark, text, lambda c: T.sentences(c, T.CJK))
    assert [x["text"] for x in got] == ["“第一句？！”", "第二句；还没结束。", "尾巴"]
    assert all(text[x["start"] : x["end"]] == x["text"] for x in got)


def test_marks_alone_are_no_sentence(spark):
    assert one(spark, "。！ ？” ", lambda c: T.sentences(c, T.CJK)) == []
    assert [x["text"] for x in one(spark, "甲，乙。", lambda c: T.clauses(c, T.CJK))] == ["甲，", "乙。"]


def test_ngrams(spark):
    assert one(spark, "片片轻鸥，落晚沙。", T.ngrams) == "片片 片轻 轻鸥 片片轻 片轻鸥 落晚 晚沙 落晚沙".split()
    assert one(spark, "片片片", lambda c: F.array_distinct(T.ngrams(c, 2, 2))) == ["片片"]
    assert one(spark, "a", T.ngrams) == []


def test_fingerprint_is_free_of_white_space(spark):
    want = hashlib.sha256("甲乙".encode()).hexdigest()
    assert one(spark, " 甲　乙\n", T.fingerprint) == want


def test_markup_and_citations(spark):
    assert one(spark, "== H ==\n{{x}}[[a|b]] and [[c]]<ref>no</ref> '''d'''", T.plain_markup) == "H\nb and c d"
    assert one(spark, "[3] and [1], [3]", T.citations) == [1, 3]
    assert one(spark, "a\U0001f600", T.utf16_length) == 3


def test_labels():
    labels = sorted({a for a, *_ in C.relations()})
    by = {(a, b): (s, p) for a, b, s, p in C.relations()}
    assert len(labels) == 27
    assert hashlib.sha256("|".join(by[a, b][0] for a in labels for b in labels).encode()).hexdigest() == "bad632c6fedc3518efb30b76da20df409e540de6e8339fdbfb48ba0b3ba8a9f9"
    prior = "|".join(",".join(a for a in labels if by[a, b][1]) for b in labels)
    assert hashlib.sha256(prior.encode()).hexdigest() == "8a7a75a6e04ffb5be963d4a0a51420b36e8d787a4793296e7f4ededd6367e843"


def test_unknown_labels_stay(spark):
    df = spark.createDataFrame([("唐", "宋"), ("明", "宋"), (None, "宋"), ("宋", "?")], "a string, b string")
    got = {(r["a"], r["b"]): r["chronology_status"] for r in C.classified(df, "a", "b", C.lookup(spark)).collect()}
    assert got == {("唐", "宋"): "clearly_earlier", ("明", "宋"): "clearly_later", (None, "宋"): "unknown", ("宋", "?"): "unknown"}


def test_fusion(spark):
    hits = spark.createDataFrame([("q", "x", 1, "a"), ("q", "x", 2, "b"), ("q", "x", 3, "a"), ("q", "y", 1, "b"), ("q", "y", 3, "a")], "q string, c string, rank int, work_id string")
    got = [(r["work_id"], r["rrf_score"], r["best_rank"], r["support"]) for r in rrf(hits, ["q"], ["c"]).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9), 1, 2), ("a", round(1 / 61 + 1 / 63, 9), 1, 2)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert df.select(V.normalised(F.col("v")).alias("r")).first()["r"] == [0.6, 0.8]
    assert df.select(V.sound(F.col("v"), 2).alias("r")).first()["r"] is False
    assert evenly_spaced(3, 101) == [0, 50, 100]


def test_covers(spark):
    a, b, c = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少春眠不觉晓", "白日依山尽黄河入海流欲穷千里目更上一层楼白日依山尽", "床前明月光疑是地上霜举头望明月低头思故乡床前明月光"
    works = spark.createDataFrame([(1, "x", a), (2, "x", b), (3, "x", c), (4, "x", a + b + c), (5, "y", a + b), (6, "x", a + "多" + b)], "work_id long, author string, content string")
    got = compose.covers(works).orderBy("member_order").collect()
    assert [(r["host"], r["member"], r["start"]) for r in got] == [(4, 1, 0), (4, 2, len(a)), (4, 3, len(a + b))]
    edges = compose.covers(works).select(F.col("host").alias("parent_work_id"), F.col("member").alias("member_work_id"), "member_order")
    assert all(r["valid"] for r in compose.validated_edges(edges, works).collect())


def test_collections_go_only_with_the_same_hit(spark):
    rows = [(1, 1, "group", "山月照人来去时候"), (1, 2, "one", "山月照人来去时候"), (1, 3, "two", "另外一句不相干的话")]
    cand = spark.createDataFrame([(*r, "") for r in rows], "query_id long, rank int, work_id string, text string, current string")
    edges = spark.createDataFrame([("group", "one"), ("group", "two")], "parent_work_id string, member_work_id string")
    none = spark.createDataFrame([], "query_id long, alias string")
    assert [(r["rank"], r["work_id"]) for r in compose.composition_filter(cand, edges, none, "current", 8).orderBy("rank").collect()] == [(1, "one"), (2, "two")]
    other = spark.createDataFrame([(1, 1, "group", "没有重合的一句话", ""), (1, 2, "one", "山月照人来去时候", "")], cand.schema)
    assert compose.composition_filter(other, edges, none, "current", 8).count() == 2


def test_containment(spark):
    body = "abcdefghij" * 6
    pairs = [("1", "x" + body, body), ("2", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a-b-c-d-e-f-g-h-i-j-k-l-m-n-o-p-q-r-s-t-u-v-w-x-y-z"), ("3", body, body[:20] + "Q" + body[21:50]), ("4", body, "zzzz")]
    got = {r["id"]: r["kind"] for r in compose.containment(spark.createDataFrame(pairs, "id string, text string, part string")).collect()}
    assert got == {"1": "exact", "2": "normalized", "3": "near", "4": "none"}


def test_refused_requests_leave_no_mark():
    assert admitted([0, 1, 2, 61, 61.5], deque(), 2, 60) == [True, True, False, True, True]
    assert admitted([0, 60], deque(), 1, 60) == [True, False]


def test_members_of_a_collection_meet_its_text_once(spark):
    """Members' hits are a list beside the collection's text, which is not copied for each edge; short hits and other questions do not count."""
    cand = [(q, i + 1, w, t, "") for q in (1, 2) for i, (w, t) in enumerate([("group", "alpha beta gamma delta"), ("one", "beta  gamma"), ("two", "ab"), ("three", "nothing of it")]) if (q, w) != (2, "one")]
    edges = spark.createDataFrame([("group", f"m{i}") for i in range(50)] + [("group", "one"), ("group", "two"), ("three", "two")], "parent_work_id string, member_work_id string")
    out = compose.composition_filter(spark.createDataFrame(cand, "query_id long, rank int, work_id string, text string, current string"), edges, spark.createDataFrame([], "query_id long, alias string"), "current", 8)
    assert [(r["query_id"], r["rank"], r["work_id"]) for r in out.orderBy("query_id", "rank").collect()] == [(1, 1, "one"), (1, 2, "two"), (1, 3, "three"), (2, 1, "group"), (2, 2, "two"), (2, 3, "three")]
    assert "exists(" in out._jdf.queryExecution().optimizedPlan().toString()
