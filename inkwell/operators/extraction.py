"""What an extraction left: coverage of source blocks, an audit by collection, and batches of cases to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(blocks: DataFrame, evidence: DataFrame, key: str, dated: Column, region: Column, section: Column) -> DataFrame:
    """key, ordinal, status: one status for each block (key, ordinal, tag, text), by the first rule that holds:

    `dated` blocks are `internal_not_exported`; those in `evidence` (key, ordinal) `handled`; an h1 is `structural_heading`; all after an
    h1 for which `region` holds, up to the next, `editorial_region`; an h2 for which `section` holds and all after it, up to the next heading
    of these two, `editorial_section`; the rest `untracked`. Conditions that are null do not hold.
    """
    along = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda c: F.coalesce(c, F.lit(False))
    in_region = held(F.last(F.when(F.col("tag") == "h1", held(region)), True).over(along))
    in_section = held(F.last(F.when(F.col("tag") == "h1", False).when(F.col("tag") == "h2", held(section)), True).over(along))
    met = blocks.join(evidence.select(key, "ordinal").distinct().withColumn("_there", F.lit(True)), [key, "ordinal"], "left")
    status = F.when(held(dated), "internal_not_exported").when(F.col("_there"), "handled").when(F.col("tag") == "h1", "structural_heading")
    status = status.when(in_region, "editorial_region").when(in_section, "editorial_section").otherwise("untracked")
    return met.select(key, "ordinal", status.alias("status"))


def audit(roles: DataFrame, warnings: DataFrame, collections: DataFrame, key: str, unclassified: str = "other", body: str = "text") -> DataFrame:
    """collection, pages, works, empty_works, untouched_pages, unclassified_blocks, unclassified_works, warnings (kind -> count).

    roles: key, ordinal, work, role (work 0: outside of works). warnings: key, warning. collections: key, collection: every page, those
    without a block or a work too. A work without a block of the role `body` is empty. Works are folded before they meet their collection.
    """
    kind = lambda r: F.count_if(F.col("role") == r)
    works = roles.groupBy(key, "work").agg(kind(body).alias("bodies"), kind(unclassified).alias("unknown"))
    inside = F.col("work") > 0
    pages = works.groupBy(key).agg(F.count_if(inside).alias("works"), F.count_if(inside & (F.col("bodies") == 0)).alias("empty"), F.sum("unknown").alias("blocks"), F.count_if(inside & (F.col("unknown") > 0)).alias("unknown"))
    met = collections.join(pages, key, "left").groupBy("collection")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = met.agg(F.count("*").alias("pages"), total("works").alias("works"), total("empty").alias("empty_works"), F.count_if(F.coalesce("works", F.lit(0)) == 0).alias("untouched_pages"), total("blocks").alias("unclassified_blocks"), total("unknown").alias("unclassified_works"))
    told = warnings.groupBy(key, "warning").agg(F.count("*").alias("n")).join(collections, key).groupBy("collection", "warning").agg(F.sum("n").alias("n"))
    told = told.groupBy("collection").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("warning", "n")))).alias("warnings"))  # a row a kind of warning
    return out.join(told, "collection", "left").withColumn("warnings", F.coalesce("warnings", F.create_map().cast("map<string,bigint>")))


def rotated_sample(candidates: DataFrame, kinds: list[str], round_number: int, limit: int, step: int = 7) -> list[dict]:
    """One case of each kind, in the order of `kinds`, until there are `limit`; a kind without a case left gives none.

    candidates: kind, book, page, place (not null, unique in a kind). Round r starts (r - 1) * step places on in each kind's pool, in the order of
    (page, place), and turns round at its end. A place is chosen once; books that no case is from yet go first. Each kind is two passes
    over its pool, one that finds the start and one that keeps the least row; only chosen rows reach the driver.
    """
    if round_number < 1 or limit < 1:
        raise ValueError("round_number and limit must be 1 or more")
    sizes = {r["kind"]: r["count"] for r in candidates.filter(F.col("kind").isin(kinds)).groupBy("kind").count().collect()}
    chosen: list[dict] = []
    for kind in kinds:
        if len(chosen) == limit:
            break
        if kind not in sizes:
            continue
        pool = candidates.filter(F.col("kind") == kind)
        first = pool.orderBy("page", "place").offset((round_number - 1) * step % sizes[kind]).limit(1).first()
        late = (F.col("page") < first["page"]) | ((F.col("page") == first["page"]) & (F.col("place") < first["place"]))
        used = F.col("book").isin([c["book"] for c in chosen]) if chosen else F.lit(False)
        for c in chosen:
            pool = pool.filter((F.col("page") != c["page"]) | (F.col("place") != c["place"]))
        best = pool.agg(F.min(F.struct(F.coalesce(used, F.lit(False)).alias("used"), late.alias("late"), "page", "place", "book")).alias("b")).first()["b"]
        if best is not None:
            chosen.append({"case_id": f"R{round_number:02d}-{len(chosen) + 1:02d}", "kind": kind, "book": best["book"], "page": best["page"], "place": best["place"]})
    return chosen
