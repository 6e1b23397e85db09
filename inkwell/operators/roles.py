"""Roles of the blocks of a page: an ordered state machine whose rules are data.

Blocks are dealt by page and sorted by place; each task runs along its blocks and carries the state of the page it is in
over Arrow batches, so a page is never gathered. A block's role depends on the blocks before it, and at one place
(the text before a signature) on the next one, which a window over the same partitioning supplies.

Every block has one role. What cannot be told is `unknown` with a warning, never body text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.plans.ship import ship


@dataclass(frozen=True)
class Rules:
    """Tags and classes are sets of names, the rest regular expressions; what is empty matches nothing."""

    part_tags: frozenset = frozenset({"h1"})
    work_tags: frozenset = frozenset({"h2"})
    zones: tuple[tuple[str, str], ...] = ()  # a part heading that matches sets the zone of its works
    skipped_part: str = ""
    skipped_work: str = ""
    inserted_tags: frozenset = frozenset()
    inserted_classes: frozenset = frozenset()
    insert_marker: str = ""
    signature_classes: frozenset = frozenset()
    signature: str = ""
    dated: str = ""
    notes: tuple[tuple[str, str], ...] = ()  # the beginning of a paragraph, and its category
    title_classes: frozenset = frozenset()
    preface_classes: frozenset = frozenset()
    reference_classes: frozenset = frozenset()
    caption_classes: frozenset = frozenset()
    break_classes: frozenset = frozenset()
    separator_classes: frozenset = frozenset()
    gap: str = ""


@dataclass
class _Work:
    number: int
    ordinal: int
    inserted: bool
    signed: bool = False
    titled: bool = False
    body: bool = False
    note: str | None = None  # the category of the notes that have begun
    markup: tuple | None = None  # of the note that the next block may continue


@dataclass
class _Page:
    """State along one page. step() gives the role of a block and the warnings (ordinal, kind, start, end)."""

    rules: Rules
    works: int = 0
    work: _Work | None = None
    before: int | None = None  # the heading of the last work that was closed
    zone: str | None = None
    date: str | None = None
    skipping: bool = False
    dropped: bool = False
    awaiting: bool = False
    warnings: list = field(default_factory=list)

    def warn(self, at: int, kind: str, start: int | None = None, end: int | None = None) -> None:
        self.warnings.append((at, kind, start, end))

    def close(self) -> None:
        if self.work:
            if self.work.inserted and not self.work.signed:
                self.warn(self.work.ordinal, "missing_signature")
            self.before = self.work.ordinal
        self.work = None

    def _heading(self, b: dict, inserted: bool) -> str:
        self.close()
        if self.awaiting and not inserted and self.before is not None:
            self.warn(self.before, "orphan_marker")
        self.awaiting = False
        self.dropped = self.skipping or (not inserted and _is(self.rules.skipped_work, b["text"]))
        if self.dropped:
            return "skipped_heading"
        self.works += 1
        self.work = _Work(self.works, b["ordinal"], inserted)
        if inserted:
            self.warn(b["ordinal"], "inserted_work")
        return "work_start"

    def _part(self, b: dict) -> str:
        self.close()
        self.awaiting = False
        zone = next((z for p, z in self.rules.zones if _is(p, b["text"])), None)
        self.zone = zone or self.zone
        self.skipping = self.dropped = zone is None and _is(self.rules.skipped_part, b["text"])
        return "part"

    def step(self, b: dict) -> str:
        r, tag, text, classes = self.rules, b["tag"], b["text"], set(b["classes"])
        if tag in r.part_tags:
            return self._part(b)
        inserted = tag in r.inserted_tags and bool(classes & r.inserted_classes)
        if tag in r.work_tags or inserted:
            return self._heading(b, inserted)
        if tag != "p":
            return "other"
        w = self.work
        if _is(r.dated, text):
            self.date = text
            if w:
                w.markup = None
            return "date_of_next"
        if _is(r.insert_marker, text):
            self.awaiting = True
            if w:
                w.markup = None
            return "insert_marker"
        if self.dropped or w is None:
            return "outside"
        if not text:
            return "separator" if w.body and not w.note and classes & r.separator_classes else "layout"
        if classes & r.break_classes:
            return "layout"
        if classes & r.caption_classes:
            w.markup = None
            return "caption"
        kind = next((k for p, k in r.notes if _is(p, text)), None)
        if w.inserted and not w.body and not w.signed:
            if classes & r.signature_classes:
                w.signed = True
                return "signature"
            if not kind and b["next_tag"] == "p" and set(b["next_classes"] or ()) & r.signature_classes and re.fullmatch(r.signature or ".{1,40}", (b["next_text"] or "").strip()):
                return "preface"
        if kind:
            w.note, w.markup = kind, (b["classes"], b["style"])
            return kind
        if not w.body and classes & r.title_classes:
            if w.titled:
                self.warn(b["ordinal"], "second_title")
            w.titled = True
            return "title"
        if not w.body and classes & r.preface_classes:
            return "preface"
        if w.note:
            if w.markup == (b["classes"], b["style"]):
                self.warn(b["ordinal"], "continued_note")
                return f"{w.note}_continued"
            w.markup = None
            self.warn(b["ordinal"], "text_after_notes")
            return "unknown"
        if w.body and classes & r.reference_classes:
            self.warn(b["ordinal"], "reference_after_text")
            return "unknown"
        w.body = True
        for m in re.finditer(r.gap, text) if r.gap else ():
            self.warn(b["ordinal"], "gap", m.start(), m.end())
        return "text"


def _is(pattern: str, text: str) -> bool:
    return bool(pattern) and re.match(pattern, text) is not None


SCHEMA = "ordinal int, work int, role string, zone string, date string, text string, warning string, start int, `end` int"


def block_roles(blocks: DataFrame, rules: Rules, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """blocks (key, ordinal, tag, classes, text, style) -> (key, ordinal, work, role, zone, date, text), (key, ordinal, warning, start, end).

    work is the number of the work on its page, from 1; 0 before the first and between works. zone and date are those that hold for the block.
    Warnings of a whole work stand at its heading. A null text is blank.
    """
    ship(blocks.sparkSession)
    kind = dict(blocks.dtypes)[key]
    w = Window.partitionBy(key).orderBy("ordinal")
    # The next block that is no blank paragraph.
    real = F.when((F.col("tag") != "p") | (F.col("text") != ""), F.struct("tag", "classes", "text"))
    ahead = F.first(real, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = blocks.select(key, "ordinal", "tag", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("style", F.lit("")).alias("style")).repartition(key).withColumn("_next", ahead)
    rows = rows.select(key, "ordinal", "tag", "classes", "text", "style", F.col("_next.tag").alias("next_tag"), F.col("_next.classes").alias("next_classes"), F.col("_next.text").alias("next_text")).sortWithinPartitions(key, "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "ordinal", "work", "role", "zone", "date", "text", "warning", "start", "end"]
        types = [None, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        page, at, out, key_type = _Page(rules), None, [], None

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.record_batch([pa.array(c, t or key_type) for c, t in zip(columns, types, strict=True)], names)

        def warned() -> None:
            out.extend((at, o, None, None, None, None, None, k, s, e) for o, k, s, e in page.warnings)
            page.warnings.clear()

        first = True
        for batch in batches:
            key_type = batch.column(key).type
            for b in batch.to_pylist():
                if first or b[key] != at:
                    page.close()
                    warned()
                    page, at, first = _Page(rules), b[key], False
                role = page.step(b)
                out.append((at, b["ordinal"], page.work.number if page.work else 0, role, page.zone, page.date, b["text"], None, None, None))
                warned()
            yield told()
            out.clear()
        page.close()
        warned()
        if out:
            yield told()

    told = rows.mapInArrow(run, f"{key} {kind}, {SCHEMA}")
    return told.filter("role IS NOT NULL").select(key, "ordinal", "work", "role", "zone", "date", "text"), told.filter("warning IS NOT NULL").select(key, "ordinal", "warning", "start", "end")
