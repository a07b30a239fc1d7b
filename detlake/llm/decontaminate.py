"""Benchmark decontamination: pigeonhole pieces, exact hits, bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import per_batch, present

#: Characters of an item that allow one edit, and items searched for in one pass over the documents.
CHARS_PER_EDIT, BLOCK = 20, 10_000

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str) -> str:
    """Lower case, ASCII punctuation as spaces, one space between words and around the text."""
    inner = b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()).decode()
    return f" {inner} " if inner else ""


class Pattern:
    """An item with its bit masks and its ``edits + 1`` pieces: a match with at most ``edits`` edits leaves one piece intact."""

    def __init__(self, text: str, chars_per_edit: int = CHARS_PER_EDIT):
        self.text, self.size = text, len(text)
        self.edits = self.size // chars_per_edit
        cuts = [i * self.size // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, text[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Smallest edit distance of the item to any stretch of ``text``, and where the first such stretch ends (Myers 1999)."""
        full = (1 << self.size) - 1
        top = 1 << (self.size - 1)
        plus, minus, score, best, end = full, 0, self.size, self.size, 0
        get = self.masks.get
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus = down | (full & ~((eq | minus) | up))
            minus = up & (eq | minus)
            if score < best:
                best, end = score, i
        return best, end


    def regions(self, origins: list[int]) -> Iterator[tuple[int, int]]:
        """Stretches of text that hold every match with a piece on one of the ascending ``origins``; those that overlap are one."""
        first = last = origins[0]
        for origin in [*origins[1:], None]:
            if origin is None or origin - last > self.size + 3 * self.edits:
                yield max(0, first - self.edits), last + self.size + 2 * self.edits
                first = origin
            last = origin


class Finder:
    """Exact search for the pieces of a block of items in normalised texts, with verification around each hit."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.patterns = [(i, Pattern(t, chars_per_edit)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        for k, (_, p) in enumerate(self.patterns):
            for start, piece in p.pieces:
                self.automaton.get(piece, None) or self.automaton.add_word(piece, (len(piece), []))
                self.automaton.get(piece)[1].append((k, start))
        if self.patterns:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Per item its closest match within the budget: distance, and place in the normalised text."""
        origins: dict[int, set[int]] = {}
        for last, (size, owners) in self.automaton.iter(text) if self.patterns and text else ():
            for k, start in owners:
                origins.setdefault(k, set()).add(last + 1 - size - start)
        found: dict[int, tuple[int, int]] = {}
        for k, places in origins.items():
            for a, z in self.patterns[k][1].regions(sorted(places)):
                distance, end = self.patterns[k][1].best(text[a:z])
                if distance <= self.patterns[k][1].edits and distance < found.get(k, (1 << 60, 0))[0]:
                    found[k] = (distance, a + end)
                if distance == 0:
                    break
        return [
            {"item_id": self.patterns[k][0], "distance": d, "start": max(0, end - self.patterns[k][1].size), "end": end}
            for k, (d, end) in sorted(found.items())
        ]


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most ``block`` items, streamed partition by partition; empty items are left out."""
    rows: list[tuple[int, str]] = []
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL").toLocalIterator():
        if r.t and (text := normalised(r.t)):
            rows.append((r.i, text))
            if len(rows) == block:
                yield rows
                rows = []
    if rows:
        yield rows


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    chars_per_edit: int = CHARS_PER_EDIT, block: int = BLOCK, name: str = "leaks",
) -> DataFrame:
    """All rows of ``docs`` with a column ``name`` (which it replaces): one struct (item_id, distance, start, end) per
    benchmark item that the whole text holds with at most one edit per ``chars_per_edit`` characters.

    The documents are read once per block of ``block`` items and never shuffled; a block is the bound of what a task holds.
    Null or empty texts hold nothing; null or empty items, and items without letters or digits, are never found; repeated
    items are found once each. Items under ``chars_per_edit`` characters must occur exactly, at word boundaries.
    """
    kept = [c for c in docs.columns if c != name]
    # the text travels once: among the other columns, unless it isn't one of them or no string
    place = kept.index(text_col) if text_col in kept and docs.schema[text_col].dataType.typeName() == "string" else None
    beside = [present(text_col).alias("data")] if place is None else []
    out = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("rest"), *beside,
        F.expr("CAST(array() AS array<struct<item_id:long,distance:int,start:long,end:long>>)").alias("leaks"),
    )
    schema = out.schema.simpleString()[len("struct<") : -1]
    for rows in _blocks(items, item_id, item_text, block):
        held = docs.sparkSession.sparkContext.broadcast(rows)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch], held=held, kind=kind) -> Iterator[pa.RecordBatch]:
            finder = None
            for b in batches:
                finder = finder or Finder(held.value, chars_per_edit)
                data = b.column("data") if place is None else b.column("rest").field(place).cast(pa.binary())
                # one text at a time is a Python object
                texts = (normalised((t.as_py() or b"").decode("utf-8", "replace")) for t in data)
                leaks = pa.array([[*chain(x.as_py(), finder.find(t))] for x, t in zip(b.column("leaks"), texts, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], leaks], b.schema.names)

        out = out.mapInArrow(run, schema)
    return out.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(kept)], F.col("leaks").alias(name))
