"""Transclusion: texts that name other texts in place, expanded to a fixpoint.

A text is cut into pieces around its marks. For each root the titles it reaches are found by joins, a level a round,
each round a written table. The order of expansion (depth first; each title once in a root) is then walked over the
links of one root, and only the finished sequence meets the texts: pieces are joined by title and put together by
place. What a root's group holds is bounded by the text that it expands to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.plans.ship import ship
from inkwell.sources.tables import cut

MARK = r"\{\{:([^{}|]+)\}\}"
GLUE = "\n\n"


def pieces(pages: DataFrame, mark: str = MARK) -> DataFrame:
    """title, i, piece, child: the text before the i-th mark and the title it names; the last piece has no child."""
    held = F.transform(F.regexp_extract_all("text", F.lit(mark), F.lit(1)), lambda x: F.trim(x))
    return pages.select("title", F.posexplode(F.arrays_zip(F.split("text", mark, -1).alias("piece"), held.alias("child")))).select("title", F.col("pos").alias("i"), F.coalesce("col.piece", F.lit("")).alias("piece"), F.col("col.child").alias("child"))


def reached(links: DataFrame, roots: DataFrame) -> DataFrame:
    """root, title: what each root reaches over links (title, child), itself included; cycles end as pairs are told once."""
    seen = frontier = cut(roots.select(F.col("title").alias("root"), "title"))
    while frontier.limit(1).count():
        new = frontier.join(links.select("title", "child").distinct(), "title").select("root", F.col("child").alias("title")).distinct()
        frontier = cut(new.join(seen, ["root", "title"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def expanded(pages: DataFrame, mark: str = MARK, roots: DataFrame | None = None) -> DataFrame:
    """title, text, complete: pages (title a unique string, text) with each mark replaced by the expanded text it names, between blank lines.

    In one expansion each title stands once, at its first place depth first: a mark that names a title which stands already (a cycle
    too) or no page gives nothing, and the text is not complete, nor is any that it stands in. A null text is empty.
    """
    ship(pages.sparkSession)
    parts = cut(pieces(pages.select("title", F.coalesce("text", F.lit("")).alias("text")), mark))
    links = parts.filter("child IS NOT NULL").select("title", "i", "child")
    roots = pages.select("title") if roots is None else roots.select("title")
    # A page's marks of one root, with a row for each page that has none, so that it is known to exist.
    shape = pages.select("title").join(links, "title", "left")
    group = reached(links, roots).join(shape, "title").select("root", "title", "i", "child")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        marks: dict = {}
        for t, i, c in zip(rows["title"], rows["i"], rows["child"], strict=True):
            marks.setdefault(t, [])
            if not pd.isna(c):
                marks[t].append((int(i), c))
        root, seen, out, whole = rows["root"].iloc[0], set(), [], True
        stack = [("open", root, 0)] if root in marks else []
        while stack:
            what, title, i = stack.pop()
            if what == "piece":
                out.append((title, i))
                continue
            if title in seen or title not in marks:
                out.append((title, -1))  # nothing, between its blank lines
                whole = False
                continue
            seen.add(title)
            todo = []
            for j, c in sorted(marks[title]):
                todo += [("piece", title, j), ("open", c, 0)]
            stack += [*todo, ("piece", title, len(marks[title]))][::-1]
        return pd.DataFrame({"root": [root] * len(out), "seq": range(len(out)), "title": [t for t, _ in out], "i": [i for _, i in out], "complete": [whole] * len(out)})

    order = group.groupBy("root").applyInPandas(walk, "root string, seq int, title string, i int, complete boolean")
    met = order.join(parts.select("title", "i", "piece"), ["title", "i"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("piece", F.lit("")).alias("piece")))), lambda x: x["piece"]), GLUE)
    return met.groupBy("root").agg(text.alias("text"), F.first("complete").alias("complete")).withColumnRenamed("root", "title")


