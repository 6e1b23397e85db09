"""Join of documents by the Jaccard similarity of their word n-grams, with set-relation skipping.

A document is the set of its distinct 4-word shingles; equal sets are one class. Two sets link when
100 * intersection >= 85 * union, so both hold one of the other's first shingles (its prefix) in any order of all
shingles. The order here: shingles that few sets hold, by hash, then the common ones by their count, so passages
that many documents share come last and stand in no prefix but of sets that consist of them. The inverted index has
a list for each prefix shingle: the sets, their sizes and the shingle's position in each.

Relations between sets are used twice:

* In the answers. In each list every set is first compared with the list's head alone, the set in which the shingle
  stands earliest. A set that links keeps its difference from the head it shares most lists with (added, removed shingles) and is a member of
  its star. Answers of a member are then derived from those of its centre: o(y, b) = o(a, b) + |added & b| -
  |removed & b|, and no o(y, z) can exceed o(a, b) + |added of y| + |added of z|. So two stars are compared by their
  centres first, then members with the other centre, then members with members, and only where the bound of the step before leaves
  a link possible and the two are not connected yet.
* In the index. A list's sets are kept in blocks of one star and one size with their least position. What a pair can share is bounded by
  what is left of both sets from that position on, so blocks whose sizes or positions rule a link out are skipped
  whole, and lists of one component are not opened again. The number of lists in which two stars meet bounds what their members share, too.

Every link between different sets is thus found, derived, refuted by a bound, or within one component, whose
pairs need not be told apart. Verification is on whole shingle sets.

Bounds: at most COMMON shingles count as common (those of max(LEAST, n / COMMON) or more occurrences among n, so they are
broadcast); a list of another shingle holds at most that many sets and LOCAL more for each CHUNK of shingles.

Defined results: a null or wordless text has an empty set, n_shingles 0, and is linked with nothing; a text of
fewer words than a shingle is one shingle; a null doc_id has component_id null; rows that share an id are one vertex, whatever
their texts; long texts are read whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import in_arrow, joined, table, written
from inkwell.llm.graph import components
from inkwell.llm.near_dup import ODD, _digest, _lists, _slices, odd_sketch, sets

WORDS, THRESHOLD = 4, 85
BOTH = 100 + THRESHOLD
#: Shingles that count as common at most, and the occurrences from which one may.
COMMON, LEAST = 1 << 20, 256
#: Shingles of a task that are counted at once; those of fewer than LOCAL occurrences among them are not told.
CHUNK, LOCAL = 1 << 21, 4
#: Classes whose ids are broadcast to find their texts; more are met by a shuffle.
MAX_BROADCAST = 1_000_000
#: Blocks of a list that a task compares with the others; pairs of one set that are given its shingles in one task.
BLOCK, DEALT = 512, 256


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in _slices(batch.column("text")):
            grams, at = sets(buf, offs, WORDS)
            yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(np.diff(at).astype(np.int64)), pa.array(_digest(grams, at)[0]), _lists(odd_sketch(grams, at).reshape(-1), np.full(b - a, ODD // 64))], ["doc_id", "n", "c", "odd"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        gram, many = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(gram[many >= LOCAL].astype(np.int64)), pa.array(many[many >= LOCAL])], ["token", "n"])

    for batch in batches:
        for _, _, buf, offs in _slices(batch.column("text")):
            held.append(sets(buf, offs, WORDS)[0])
            if sum(map(len, held)) >= CHUNK:
                yield told()
                held.clear()
    if held:
        yield told()


def common(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(common shingles ascending, their places in the order); at most COMMON of them."""
    found = in_arrow(docs.select("text"), _counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(LEAST, -(-total // COMMON)))
    t = found.toArrow()
    token, many = t.column("token").to_numpy(), t.column("n").to_numpy()
    by = np.argsort(token)
    rank = np.empty(len(token), np.uint64)
    rank[np.lexsort((token, many))] = np.arange(len(token), dtype=np.uint64)
    return token[by].astype(np.uint64), rank[by]


def prefix(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n of which a linked set holds one."""
    return n - -(-n * THRESHOLD // 100) + 1


def postings(docs: DataFrame, told, of_common: bool) -> DataFrame:
    """token, c, n, pos: the prefixes' shingles, either common or others; equal sets of a slice are folded, c is their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = told.value
        for batch in batches:
            for a, b, buf, offs in _slices(batch.column("text")):
                grams, at = sets(buf, offs, WORDS)
                n, c = np.diff(at), _digest(grams, at)[0]
                row = np.repeat(np.arange(b - a), n)
                key = grams.copy()
                is_hot = np.zeros(len(grams), bool)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    is_hot = hot[i] == grams
                    key[is_hot] = K.U64(1 << 48) + rank[i[is_hot]]
                by = np.argsort((row.astype(K.U64) << K.U64(49)) | key)  # rows are fewer than 2^13
                pos = np.arange(len(by)) - np.repeat(at[:-1], n)
                mine = np.zeros(b - a, bool)
                mine[np.unique(c, return_index=True)[1]] = True
                take = (pos < np.repeat(prefix(n), n)) & (is_hot[by] == of_common) & mine[row]
                yield pa.record_batch([pa.array(grams[by[take]].astype(np.int64)), pa.array(c[row[take]]), pa.array(n[row[take]].astype(np.int32)), pa.array(pos[take].astype(np.int32))], ["token", "c", "n", "pos"])

    return in_arrow(docs.select("text"), run, "token long, c long, n int, pos int")


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.column("c").to_numpy()
        for a, b, buf, offs in _slices(batch.column("text")):
            grams, at = sets(buf, offs, WORDS)
            out = pa.record_batch([batch.column("c")[a:b], batch.column("extra")[a:b], _lists(grams.view(np.int64), np.diff(at))], ["c", "extra", "grams"])
            yield out.filter(pa.array(c[a:b] == _digest(grams, at)[0]))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text and the columns of wanted (rep, c, ...): the texts of the documents `rep`."""
    few = wanted.count() <= MAX_BROADCAST
    return docs.withColumnRenamed("doc_id", "rep").join(F.broadcast(wanted) if few else wanted, "rep")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """c, extra, grams of the classes wanted (rep, c, extra: a struct that is handed on)."""
    return in_arrow(texts_of(docs, wanted).select("text", "c", "extra"), _shingle, f"c long, extra {dict(wanted.dtypes)['extra']}, grams array<long>")


def _may(n: Column, m: Column, shared: Column) -> Column:
    """Whether sets of n and m shingles link if they share so many."""
    return shared * BOTH >= (n + m) * THRESHOLD


def _shared(differ: list[tuple[Column, Column]], n: Column, m: Column) -> Column:
    """An upper bound of what two sets share, by their sketches."""
    return F.floor((n + m - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in differ), F.lit(0))) / 2)


def _bound(x: str, y: str, n: Column, m: Column) -> Column:
    """_shared of the sketches in columns x and y."""
    return _shared([(F.col(x)[i], F.col(y)[i]) for i in range(ODD // 64)], n, m)


def given(pairs: DataFrame, key: str, docs: DataFrame, classes: DataFrame, out: str) -> DataFrame:
    """pairs with the shingles of the class `key` in `out`; a class of many pairs is dealt over several tasks."""
    counts = written(pairs.groupBy(key).agg(F.ceil(F.count("*") / DEALT).cast("int").alias("_parts")))
    wanted = classes.join(counts, classes["c"] == counts[key]).select("rep", "c", F.struct("_parts").alias("extra"))
    full = sets_of(docs, wanted).select(F.col("c").alias(key), F.explode(F.sequence(F.lit(0), F.col("extra._parts") - 1)).alias("_part"), F.col("grams").alias(out))
    dealt = pairs.join(counts, key).withColumn("_part", F.pmod(F.xxhash64(*pairs.columns), F.col("_parts")).cast("int")).drop("_parts")
    return dealt.join(full, [key, "_part"]).drop("_part")


def lists(docs: DataFrame, told, any_common: bool) -> DataFrame:
    """token, c, n, pos, head (pos, n, c): the index without lists of one set."""
    head = F.min(F.struct("pos", "n", "c"))
    rare = postings(docs, told, False).dropDuplicates(["token", "c"])
    w = Window.partitionBy("token")  # of bounded length
    out = rare.select("*", F.count("*").over(w).alias("_k"), head.over(w).alias("head")).filter("_k > 1").drop("_k")
    if any_common:
        hot = postings(docs, told, True)
        facts = hot.groupBy("token").agg(F.countDistinct("c").alias("_k"), head.alias("head")).filter("_k > 1").drop("_k")
        out = out.unionByName(hot.join(F.broadcast(facts), "token").select("token", "c", "n", "pos", "head"))
    return written(out)


def stars(index: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, y, n, added, removed: for a class its head a that it links with, and its difference from it."""
    h = F.col("head")
    met = index.filter((h["c"] != F.col("c")) & _may(F.col("n"), h["n"], F.least(F.col("n") - F.col("pos"), h["n"] - h["pos"])))
    best = met.groupBy("c", h["c"].alias("a")).agg(F.count("*").alias("k")).groupBy("c").agg(F.max(F.struct("k", F.col("a"))).alias("best")).select(F.col("best.a").alias("a"), F.col("c").alias("y"))
    own = classes.select("c", "n", *[F.col("odd")[i].alias(f"o{i}") for i in range(ODD // 64)])
    best = best.join(own.toDF(*["a", "n_a", *[f"x{i}" for i in range(ODD // 64)]]), "a").join(own.toDF(*["y", "n", *[f"y{i}" for i in range(ODD // 64)]]), "y")
    near = written(best.filter(_may(F.col("n"), F.col("n_a"), _shared([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(ODD // 64)], F.col("n"), F.col("n_a")))).select("a", "y", "n", "n_a"))
    # A star's members meet its centre in tasks of DEALT; each set is read and sent once.
    parts = written(near.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("_parts")))
    dealt = near.join(parts, "a").withColumn("_part", F.pmod(F.xxhash64("y"), F.col("_parts")).cast("int"))
    rep = classes.select("rep", "c")
    members = sets_of(docs, dealt.withColumnRenamed("y", "c").join(rep, "c").select("rep", "c", F.struct("a", "_part", "n", "n_a").alias("extra"))).select("extra.*", F.col("c").alias("y"), F.col("grams").alias("mine"))
    centres = sets_of(docs, parts.withColumnRenamed("a", "c").join(rep, "c").select("rep", "c", F.struct("_parts").alias("extra"))).select(F.col("c").alias("a"), F.explode(F.sequence(F.lit(0), F.col("extra._parts") - 1)).alias("_part"), F.col("grams").alias("other"))
    both = members.join(centres, ["a", "_part"]).select("a", "y", "n", "n_a", F.array_except("mine", "other").alias("added"), F.array_except("other", "mine").alias("removed"))
    return written(both.filter(_may(F.col("n"), F.col("n_a"), F.col("n") - F.size("added"))).select("a", "y", "n", "added", "removed").dropDuplicates(["y"]))


def star_pairs(index: DataFrame, place: DataFrame) -> DataFrame:
    """Pairs of stars (a, b) in different components that some list does not rule out; place: c, a, component."""
    own = index.select("token", "c", "n", "pos").join(place, "c", "left").select("token", F.coalesce("a", "c").alias("a"), F.coalesce("component", "c").alias("component"), "n", "pos")
    blocks = written(own.groupBy("token", "a", "component", "n").agg(F.min("pos").alias("pos")))
    open_lists = written(blocks.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("token", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts")))
    rest = written(joined(blocks, open_lists, ["token"]).withColumn("band", F.floor(F.log("n") / math.log(100 / THRESHOLD) + 1e-9).cast("int")))
    # A size meets its own band of sizes and both neighbours; a long list is cut into parts, each of which meets all of it.
    x = rest.select("token", "band", F.pmod(F.xxhash64("a", "n"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}_x") for c in ("a", "component", "n", "pos")])
    y = rest.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "parts", *[F.col(c).alias(f"{c}_y") for c in ("a", "component", "n", "pos")]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n, m = F.col("n_x"), F.col("n_y")
    met = x.join(y, ["token", "band", "part"]).filter((F.col("a_x") < F.col("a_y")) & (F.col("component_x") != F.col("component_y")) & _may(n, m, F.least(n, m)))
    # Beyond its prefix a set has 85 % of its shingles at most. The prefix that ends first in the order holds all that is shared up
    # there, so the lists in which two sets meet and the rest of the larger one bound what they share.
    rest_of = lambda c: F.floor((c * THRESHOLD + 99) / 100) - 1
    need = F.ceil((n + m) * THRESHOLD / BOTH - 1e-9) - F.greatest(rest_of(n), rest_of(m))
    open_here = F.when(_may(n, m, F.least(n - F.col("pos_x"), m - F.col("pos_y"))), need)
    met = met.groupBy(F.col("a_x").alias("a"), F.col("a_y").alias("b")).agg(F.count("*").alias("k"), F.min(open_here).alias("need"))
    return written(met.filter("k >= need").select("a", "b"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs whose stars a and b are not connected yet."""
    side = lambda k: found.select(F.col("v").alias(k), F.col("component").alias(f"_{k}"))
    told = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return told.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(pairs.columns)


def derived(pairs: DataFrame, members: DataFrame, docs: DataFrame, classes: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """links (a, b) and those between the members of the pairs of stars, each overlap derived from that of the centres."""
    slack = F.size("added") * BOTH - F.col("n") * THRESHOLD
    each = members.select("a", F.col("y").alias("v"), "n", "added", "removed")
    alone = classes.join(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "c"), "c").select(F.col("c").alias("a"), F.col("c").alias("v"), "n", F.array().cast("array<long>").alias("added"), F.array().cast("array<long>").alias("removed"))
    each = each.join(alone.select("a"), "a", "left_semi").unionByName(alone)
    each = written(each.join(classes.select(F.col("c").alias("v"), "odd"), "v").withColumn("slack", slack))
    most = written(each.groupBy("a").agg(F.max("slack").alias("most")))
    cells = [F.col("odd")[i].alias(f"o{i}") for i in range(ODD // 64)]
    own = classes.join(most, classes["c"] == most["a"]).select("a", "n", "most", *cells)
    side = lambda k: own.toDF(k, f"n_{k}", f"most_{k}", *[f"{k}{i}" for i in range(ODD // 64)])
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    ub = _shared([(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(ODD // 64)], F.col("n_a"), F.col("n_b"))
    near = written(near.filter(ub * BOTH + F.col("most_a") + F.col("most_b") >= 0).select("a", "b", "n_a", "n_b", "most_a", "most_b"))
    if not near.limit(1).count():
        return links
    met = given(given(near, "a", docs, classes, "x"), "b", docs, classes, "y")
    centres = written(met.select("a", "b", "n_a", "n_b", "most_a", "most_b", F.size(F.array_intersect("x", "y")).alias("o")).filter(F.col("o") * BOTH + F.col("most_a") + F.col("most_b") >= 0).distinct())
    linked = centres.filter(_may(F.col("n_a"), F.col("n_b"), F.col("o"))).select("a", "b")
    if linked.limit(1).count():  # stars whose centres link need no look at their members
        links = links.unionByName(linked)
        found = components(links)
        centres = written(_apart(centres, found))
    centres = centres.drop("n_a", "n_b")
    # Members of either star with the centre of the other, where neither the centres' overlap nor the sketches rule all links out.
    turned = centres.unionByName(centres.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("most_b").alias("most_a"), F.col("most_a").alias("most_b"), "o"))
    turned = turned.join(classes.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b")), "b")
    may = (F.col("o") * BOTH + F.col("slack") + F.col("most_b") >= 0) & (_bound("odd", "odd_b", F.col("n"), F.col("n_b")) * BOTH - F.col("n") * THRESHOLD + F.col("most_b") >= 0)
    one = turned.join(each, "a").filter(may).select("a", "b", "most_b", "o", "v", "n", "slack", "added", "removed", "odd")
    one = given(written(one), "b", docs, classes, "y").withColumn("o", F.col("o") + F.size(F.array_intersect("added", "y")) - F.size(F.array_intersect("removed", "y"))).drop("y")
    one = written(one.filter(F.col("o") * BOTH - F.col("n") * THRESHOLD + F.col("most_b") >= 0).dropDuplicates(["a", "b", "v"]))
    size = classes.select(F.col("c").alias("b"), F.col("n").alias("n_b"))
    linked = written(one.join(size, "b").filter(_may(F.col("n"), F.col("n_b"), F.col("o"))).select(F.col("v").alias("a"), "b"))
    links = links.unionByName(linked)
    if linked.limit(1).count():
        found = components(links)
    # Members of a with members of b, where still apart and neither side's overlap with the other centre rules a link out.
    left = _apart(one, found).filter("v <> a")
    x = left.filter("a < b").select("a", "b", "v", "n", "o", F.col("slack").alias("slack_v"), F.col("odd").alias("odd_v"))
    y = left.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("v").alias("z"), F.col("n").alias("m"), F.col("o").alias("p"), F.col("slack").alias("slack_z"), F.col("odd").alias("odd_z"), "added", "removed")
    open_both = (F.col("o") * BOTH - F.col("n") * THRESHOLD + F.col("slack_z") >= 0) & (F.col("p") * BOTH - F.col("m") * THRESHOLD + F.col("slack_v") >= 0)
    two = x.join(y, ["a", "b"]).filter(open_both & _may(F.col("n"), F.col("m"), _bound("odd_v", "odd_z", F.col("n"), F.col("m"))))
    two = written(two.select("v", "z", "n", "m", "o", "added", "removed"))
    if not two.limit(1).count():
        return links
    two = given(two, "v", docs, classes, "x").withColumn("o", F.col("o") + F.size(F.array_intersect("added", "x")) - F.size(F.array_intersect("removed", "x")))
    return links.unionByName(written(two.filter(_may(F.col("n"), F.col("m"), F.col("o"))).select(F.col("v").alias("a"), F.col("z").alias("b")).distinct()))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; one row a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(in_arrow(docs, _sign, "doc_id long, n long, c long, odd array<long>"))
    named = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("odd").alias("odd"), F.count("*").alias("copies")))
    # Rows of one id are one vertex.
    same = named.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a < z").select("doc_id", "a")
    links = written(named.select("doc_id", F.col("c").alias("b")).join(same, "doc_id").filter("a <> b").select("a", "b").distinct())
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = common(docs, total)
    told = docs.sparkSession.sparkContext.broadcast(hot)
    index = lists(docs.filter("doc_id IS NOT NULL"), told, len(hot[0]) > 0)
    members = stars(index, docs, classes)
    links = links.unionByName(members.select("a", F.col("y").alias("b")))
    found = components(links)
    place = members.select(F.col("y").alias("c"), "a")
    place = written(found.select(F.col("v").alias("c"), "component").join(place, "c", "left").select("c", F.coalesce("a", "c").alias("a"), "component"))
    pairs = star_pairs(index, place)
    if pairs.limit(1).count():
        links = derived(pairs, members, docs, classes, links, found)
        found = components(links)
    known = classes.select("c", "rep", "copies").join(found.withColumnRenamed("v", "c"), "c", "left").filter("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "c"))
    known = written(known)
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = joined(known, least, ["component"]).select("c", "component_id")
    out = joined(signed.select("doc_id", "n", "c"), known, ["c"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12_set_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
