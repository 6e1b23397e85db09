"""Sharding by fixed virtual slots (DataFrame functions only).

A record hashes into one of VIRTUAL slots and never leaves it. Rows and bytes
are summed by slot, and a versioned map says which shard holds each slot.
Version 0 deals the slots round; rebalancing makes the next version, in which
only edited slots differ: a shard keeps its largest slots up to the mean load,
and the others but empty ones go, largest first, to the shard that is least loaded then.
Adding a shard is the same edit with one more, empty shard. `store` and `load` keep
all versions of a map in one named folder; `shard` reads the last one there and
writes the edited one beside it.

The law of the query is `bytes`: shards hold nearly equal bytes. The record, not
its text, is hashed, so copies of one text spread over all shards; equal records
(same id, bytes and CRC) are numbered, and the number is hashed too, so they spread as well.

Texts are read once: equal records become one row with their number, which is
written. Records of more than RUN copies are dealt out in runs before they are
numbered, so none of them is unfolded in one task.

Per-slot sums and the map have VIRTUAL rows at most, whatever the input, so the
map is broadcast. A row's place in its shard comes from the slots' row counts
and its place in the slot; no task sees a shard.

Defined results: a null text has no bytes, CRC 0 and size 8; a null doc_id
hashes like the empty string; repeated rows are dealt one by one, by their number;
ties of places go by number; a long text counts in one piece, as a record is never
cut; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import shared_dir, table, written

#: Virtual slots: fixed for the life of the data set.
VIRTUAL = 8192
OVERHEAD = 8
#: Equal records that are numbered together.
RUN = 1 << 16


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, copies: equal records are one row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return out.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))


def slotted(records: DataFrame, virtual: int = VIRTUAL) -> DataFrame:
    """counted() -> doc_id, size, text_crc32, copy (number of an equal record, from 0) and its virtual slot."""
    few = records.filter(F.col("copies") <= RUN).withColumn("_from", F.lit(0).cast("long"))
    many = records.filter(F.col("copies") > RUN).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    runs = few.union(many.repartition("doc_id", "text_crc32", "_from"))
    out = runs.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, "copies") - 1))).drop("_from", "copies")
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "copy")
    return out.withColumn("virtual_slot", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % virtual).cast("int"))


def first_map(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """Version 0 of the map: virtual_slot, shard, version."""
    return spark.range(virtual).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def loads(records: DataFrame) -> DataFrame:
    """virtual_slot, slot_rows, slot_bytes: one row a slot in use."""
    return records.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def rebalanced(held: DataFrame, by_slot: DataFrame, shards: int) -> DataFrame:
    """The next version of the map `held`, in which shards 0 to shards - 1 have nearly equal bytes.

    Returns every slot; `version` is the one that last moved it. All frames here
    have one row a slot, and the edit is one fold over the slots to move.
    """
    joined = held.join(by_slot, "virtual_slot", "left").select("virtual_slot", "shard", "version", F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes"))
    own = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot")
    mean = F.sum("slot_bytes").over(Window.partitionBy()) / shards
    seen = joined.withColumn("stays", ((F.sum("slot_bytes").over(own) <= mean) | (F.col("slot_bytes") == 0)) & (F.col("shard") < shards)).withColumn("_next", F.max("version").over(Window.partitionBy()) + 1)
    moved = F.filter("slots", lambda s: ~s["stays"])
    kept = F.filter("slots", lambda s: s["stays"])
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    start = F.aggregate(kept, zero, lambda a, s: F.transform(a, lambda x, i: F.when(i == s["shard"], x + s["slot_bytes"]).otherwise(x)))
    into = lambda a: (F.array_position(a, F.array_min(a)) - 1).cast("int")
    placed = F.aggregate(
        F.sort_array(F.transform(moved, lambda s: F.struct(s["slot_bytes"].alias("b"), s["virtual_slot"].alias("v"))), asc=False),
        F.struct(start.alias("load"), F.array().cast("array<struct<v:int,shard:int>>").alias("to")),
        lambda a, s: F.struct(
            F.transform(a["load"], lambda x, i: F.when(i == into(a["load"]), x + s["b"]).otherwise(x)).alias("load"),
            F.array_append(a["to"], F.struct(s["v"].alias("v"), into(a["load"]).alias("shard"))).alias("to"),
        ),
    )
    edits = seen.groupBy().agg(F.collect_list(F.struct("virtual_slot", "shard", "slot_bytes", "stays")).alias("slots")).select(F.explode(placed["to"]).alias("e")).select(F.col("e.v").alias("virtual_slot"), F.col("e.shard").alias("new"))
    changed = F.col("new").isNotNull() & (F.col("new") != F.col("shard"))
    return seen.join(edits, "virtual_slot", "left").select("virtual_slot", F.when(changed, F.col("new")).otherwise(F.col("shard")).alias("shard"), F.when(changed, F.col("_next")).otherwise(F.col("version")).alias("version"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the map in the folder `path`, ascending; none if there is no map."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException:  # no such folder
        return []
    return sorted(r[0] for r in held.select("map_version").distinct().collect())  # a row a version


def store(held: DataFrame, path: str) -> int:
    """Writes the map as the next version in the folder `path`; versions that are there stay as they are."""
    version = held.agg(F.max("version")).first()[0]
    known = versions(held.sparkSession, path)
    if known and version <= known[-1]:  # an edit that moved nothing
        return known[-1]
    held.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/map_version={version}")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """virtual_slot, shard, version of the named (or the last) version of the map in the folder `path`."""
    known = versions(spark, path)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise ValueError(f"{path}: no version {version}; there are {known}")
    return spark.read.parquet(path).filter(F.col("map_version") == version).select("virtual_slot", "shard", "version")


def shard(docs: DataFrame, shards: int, virtual: int = VIRTUAL, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot, map_version.

    `path` names the folder of the map: its last version is edited, and the edited one stored there. Without it, a new
    map is made in a folder of its own.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/inkwell/maps/{uuid.uuid4().hex}"
    records = slotted(written(counted(docs)), virtual)
    by_slot = written(loads(records))
    if not versions(spark, path):
        store(first_map(spark, shards, virtual), path)
    store(written(rebalanced(load(spark, path), by_slot, shards)), path)
    now = load(spark, path)
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = now.join(by_slot, "virtual_slot").withColumn("_start", F.coalesce(F.sum("slot_rows").over(ahead), F.lit(0)))
    starts = starts.select("virtual_slot", "shard", "version", "_start")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    out = records.withColumn("_place", place).join(F.broadcast(starts), "virtual_slot")  # at most `virtual` rows
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)


#: Remainders of the 16 half bytes for the CRC-32 polynomial 0xEDB88320.
NIBBLES = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def _half(c: str, shift: str) -> str:
    return f"xor(({c}) >> 4, {NIBBLES}[(xor({c}, {shift}) & 15) + 1])"


ORACLE = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT DISTINCT text, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM t),
y AS (SELECT text, len(bytes) + {OVERHEAD} AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda h: ('0x' || h)::BIGINT)), lambda c, b: {_half(_half("c", "b"), "(b >> 4)")}), 4294967295) AS crc FROM x),
r AS (SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, row_number() OVER (PARTITION BY doc_id, size, crc) - 1 AS copy FROM t JOIN y USING (text)),
v AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || text_crc32 || '/' || copy), 1, 8))::BIGINT % {VIRTUAL})::INT AS vs FROM r),
l AS (SELECT vs, count(*) AS slot_rows, sum(size)::BIGINT AS slot_bytes FROM v GROUP BY vs),
a AS (SELECT s::INT AS vs, (s % 24)::INT AS shard, coalesce(slot_bytes, 0)::BIGINT AS b FROM range({VIRTUAL}) g(s) LEFT JOIN l ON vs = s),
k AS (SELECT *, b = 0 OR sum(b) OVER (PARTITION BY shard ORDER BY b DESC, vs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= (sum(b) OVER ())::DOUBLE / 24 AS stays FROM a),
mv AS (SELECT vs, shard AS old, b, row_number() OVER (ORDER BY b DESC, vs DESC) AS i FROM k WHERE NOT stays),
st AS (SELECT list(coalesce(s, 0) ORDER BY shard)::BIGINT[] AS load FROM (SELECT shard, sum(b) FILTER (stays) AS s FROM k GROUP BY shard)),
f AS (SELECT 0::BIGINT AS i, NULL::INT AS vs, NULL::INT AS shard, NULL::INT AS old, load FROM st
      UNION ALL
      SELECT mv.i, mv.vs, list_position(f.load, list_min(f.load))::INT - 1, mv.old,
             list_transform(f.load, lambda z, j: CASE WHEN j = list_position(f.load, list_min(f.load)) THEN z + mv.b ELSE z END) FROM f JOIN mv ON mv.i = f.i + 1),
now AS (SELECT k.vs, coalesce(f.shard, k.shard) AS shard, CASE WHEN f.shard <> f.old THEN 1 ELSE 0 END AS version FROM k LEFT JOIN f ON f.vs = k.vs),
s AS (SELECT vs, shard, version, coalesce(sum(slot_rows) OVER (PARTITION BY shard ORDER BY vs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM now JOIN l USING (vs))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (start + row_number() OVER (PARTITION BY vs ORDER BY doc_id NULLS FIRST, text_crc32, size, copy) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard, vs AS virtual_slot, version AS map_version
FROM v JOIN s USING (vs)
"""
