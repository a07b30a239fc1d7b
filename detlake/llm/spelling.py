"""Spelling variants: words one edit apart, found with bit sets per (position, letter) over the vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow.compute import sort_indices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import present

#: Code points of a word at least, occurrences at least, and how many times as frequent a form must be.
SMALLEST, SEEN, TIMES = 7, 2, 10
#: Letters of a group at most; larger ones are divided again, and smaller ones share an index up to that. Words a task counts before it passes them on.
LETTERS, HELD = 1 << 17, 200_000
#: Positions and (query, block) items looked at together.
POSITIONS, ITEMS = 64, 1 << 17


def runs(text: bytes, smallest: int = SMALLEST) -> list[str]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of at least ``smallest`` code points, only A-Z in lower case."""
    return re.findall(f"[a-zÀ-ÿ]{{{smallest},}}", text.lower().decode("utf-8", "replace"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: int = SMALLEST, seen: int = SEEN, slip: int | None = None) -> DataFrame:
    """``(word, n)`` of all words of at least ``smallest`` code points that occur ``seen`` times or more.

    With ``slip``, a run whose crc32 of ``<id>:<run>`` is divisible by it loses the code point at crc32 modulo its length, a typing
    error made on purpose. A null id is an empty string there. Tasks add up words before anything is shuffled.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), present(text_col).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for b in batches:
            for d, text in zip(b.column("id").to_pylist(), b.column("data").to_pylist(), strict=True):
                found = Counter(runs(text, smallest))
                if not slip:
                    counts.update(found)
                    continue
                begun = crc32(f"{d}:".encode())
                for w, n in found.items():
                    h = crc32(w.encode(), begun)
                    if h % slip == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                        if len(w) < smallest:
                            continue
                    counts[w] += n
                if len(counts) > HELD:
                    yield out()
        if counts:
            yield out()

    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def _key(s: Column, e: Column) -> tuple[Column, Column]:
    """What two words whose first difference lies in [s, e) share: the first s letters, and the letters behind e."""
    return F.substring("word", F.lit(1), s), F.expr("right(word, greatest(m - e, 0))")


def _shortest(words: DataFrame) -> Column:
    """Length of the shortest word, as a constant."""
    return F.lit(words.agg(F.min(F.length("word"))).first()[0] or 0)


def grouped(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``(m, s, e, pre, suf, word, n)``: each word under every group in which it can meet words one edit away.

    A pair's class m is the length of the shorter word, and its place p (0 to m) the first position at which they differ. The
    places are cut into intervals [s, e); the two words share their first s letters and the last m - e, so each pair meets in
    exactly one group. Groups of more than ``letters`` letters are divided, which halves the interval and lengthens what is shared;
    with one place left a group holds the words that differ in one letter only, so no group grows with the vocabulary.
    """
    length = F.length("word")
    classes = F.when(length > _shortest(words), F.array(length, length - 1)).otherwise(F.array(length))
    rows = words.select("word", "n", F.explode(classes).alias("m"))
    half = (F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), (F.col("m") + 1).alias("e")))
    rows = rows.select("word", "n", "m", F.explode(sides).alias("side")).select("word", "n", "m", "side.s", "side.e")
    cols = ["m", "s", "e", "pre", "suf", "word", "n"]

    def keyed(df: DataFrame) -> DataFrame:
        pre, suf = _key(F.col("s"), F.col("e"))
        return df.withColumn("pre", pre).withColumn("suf", suf).select(cols)

    key = cols[:5]
    rows, done = materialize(keyed(rows), "members"), None
    while True:
        large = rows.where("e - s > 1").groupBy(key).agg((F.count("*") * F.col("m")).alias("size")).where(F.col("size") > letters).select(key)
        large = materialize(large, "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rest = rows.join(large, key, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        mid = ((F.col("s") + F.col("e")) / 2).cast("int")
        parts = F.array(F.struct(F.col("s"), mid.alias("e")), F.struct(mid.alias("s"), F.col("e")))
        split = rows.join(large, key, "left_semi").select("word", "n", "m", F.explode(parts).alias("side"))
        rows = materialize(keyed(split.select("word", "n", "m", "side.s", "side.e")), "members")


class Index:
    """Bit sets of the words of some groups of one class and interval.

    Word number i is bit i mod 64 of block i // 64. Groups that fit a block never cross its border, larger ones begin at a block,
    so a word is compared with the blocks of its own group only.
    """

    def __init__(self, m: int, s: int, e: int):
        self.kind = m, s, e
        self.words: list[str] = []
        self.n: list[int] = []
        self.slots: list[int] = []
        self.groups: list[tuple[int, int]] = []
        self.end = 0

    def add(self, words: list[str], n: list[int]) -> None:
        size = len(words)
        if self.end % 64 + size > 64:
            self.end = -(-self.end // 64) * 64
        self.groups.append((len(self.words), size))
        self.slots.extend(range(self.end, self.end + size))
        self.end += size
        self.words.extend(words)
        self.n.extend(n)

    def _codes(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """Letters a to b - 1 of all words as small numbers; 0 stands behind a word's end."""
        part = np.array([w[a:b] for w in self.words], f"U{b - a}").view(np.uint32).reshape(len(self.words), b - a)
        letters, codes = np.unique(part, return_inverse=True)
        return codes.reshape(part.shape), len(letters)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows (shorter or equal, longer or equal) of all pairs one edit apart whose first difference lies in [s, e)."""
        (m, s, e), count = self.kind, len(self.words)
        slots = np.array(self.slots, np.int64)
        block, bit = slots >> 6, np.uint64(1) << (slots & 63).astype(np.uint64)
        blocks = int(block[-1]) + 1
        row_at = np.full(blocks * 64, -1, np.int64)
        row_at[slots] = np.arange(count)
        longer = np.fromiter(map(len, self.words), np.int64, count) == m + 1
        sets = np.zeros((2, blocks), np.uint64)  # words of length m, words of length m + 1
        np.add.at(sets, (longer.astype(np.int64), block), bit)
        # one item per query and block of its group; the group's own bits are where the zero-error set begins
        first, size = np.array(self.groups, np.int64).T
        group = np.repeat(np.arange(len(first)), size)
        last = block[first + size - 1]
        query = np.flatnonzero(~longer)
        spans = last[group[query]] - block[first[group[query]]] + 1
        item = np.repeat(query, spans)
        at = np.arange(len(item)) - np.repeat(np.cumsum(spans) - spans, spans) + block[first[group[item]]]
        whole = np.uint64((1 << 64) - 1)
        low, high = slots[first[group[item]]], slots[first[group[item]] + size[group[item]] - 1]
        begin = np.where(at == low >> 6, whole << (low & 63).astype(np.uint64), whole)
        zero = begin & np.where(at == high >> 6, whole >> (63 - (high & 63)).astype(np.uint64), whole)
        replaced, inserted = np.zeros_like(zero), np.zeros_like(zero)
        for a in range(s, min(e, m), POSITIONS):
            b = min(a + POSITIONS, e, m)
            codes, kinds = self._codes(a, b + 1)
            index = np.zeros((b + 1 - a, kinds, blocks), np.uint64)
            for i in range(b + 1 - a):
                np.add.at(index[i], (codes[:, i], block), bit)
            for x in range(0, len(item), ITEMS):
                y = slice(x, x + ITEMS)
                z, r, g, own, where = zero[y], replaced[y], inserted[y], codes[item[y]], at[y]
                for i in range(b - a):
                    here, beyond = index[i][own[:, i], where], index[i + 1][own[:, i], where]
                    r = (r & here) | (z & ~here)
                    g = (g | (z & ~here)) & beyond
                    z = z & here
                zero[y], replaced[y], inserted[y] = z, r, g
        if e > m:
            inserted |= zero  # one letter more at the end
        near = (replaced & sets[0][at]) | (inserted & sets[1][at])
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        one, place = np.nonzero(bits)
        u, v = item[hit[one]], row_at[at[hit[one]] * 64 + place]
        once = (u < v) | longer[v]  # words of one length find each other twice
        return u[once], v[once]

    def found(self) -> pa.RecordBatch:
        """Per word with near words here: their number, and the one of largest n, the smallest in code-point order among equals."""
        u, v = self.pairs()
        words, n = pa.array(self.words, pa.string()), pa.array(self.n, pa.int64())
        best_first = sort_indices(pa.table({"n": n, "word": words}), [("n", "descending"), ("word", "ascending")]).to_numpy()
        rank = np.empty(len(best_first), np.int64)
        rank[best_first] = np.arange(len(rank))
        best, count = np.full(len(rank), len(rank)), np.zeros(len(rank), np.int64)
        for one, other in ((u, v), (v, u)):
            np.minimum.at(best, one, rank[other])
            np.add.at(count, one, 1)
        has = np.flatnonzero(count)
        form = pa.array(best_first[best[has]])
        return pa.RecordBatch.from_arrays([words.take(pa.array(has)), pa.array(count[has]), words.take(form), n.take(form)], NAMES)


NAMES = ["word", "n_near", "near", "near_n"]


def _near(groups: DataFrame) -> DataFrame:
    """``(word, n_near, near, near_n)`` per word and group in which it has near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, key, words, n = None, None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal index
            if len(words) > 1 and min(map(len, words)) == key[0]:
                kind = tuple(key[:3])
                if index and (index.kind != kind or (len(index.words) + len(words)) * kind[0] > LETTERS):
                    yield index.found()
                    index = None
                index = index or Index(*kind)
                index.add(words, n)

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for *k, w, c in zip(*cols, strict=True):
                if k != key:
                    yield from close()
                    key, words, n = k, [], []
                words.append(w)
                n.append(c)
        yield from close()
        if index:
            yield index.found()

    key = ["m", "s", "e", "pre", "suf"]
    ranged = groups.repartition(*key).sortWithinPartitions(*key)
    return ranged.mapInArrow(run, "word string, n_near long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, form)`` -> ``(word, root)``, the last word that is reached by following the forms.

    Each round doubles the steps that are followed. A form occurs ``times`` as often as its word, so there are no circles and few steps.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(further, "root", "left")
        if step.where("next IS NOT NULL").isEmpty():
            return links
        links = materialize(step.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(words: DataFrame, times: int = TIMES, letters: int = LETTERS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per row of ``words`` (word, n): near words differ by one inserted, deleted or replaced
    code point; the form is the near word of largest n, ties to the smallest, if it occurs ``times`` as often; roots follow the forms.

    Words must be distinct and not null. A word without near words has none; an empty table gives an empty result. Other
    columns are ignored.
    """
    words = materialize(words.select("word", "n"), "words")
    none = F.lit(None)
    found = _near(grouped(words, letters)).withColumn("n", none.cast("long"))
    own = words.select("word", F.lit(0).cast("long").alias("n_near"), none.cast("string").alias("near"), none.cast("long").alias("near_n"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    all_words = found.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    counted = all_words.withColumn("form_n", F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")))
    counted = counted.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", "n_near", "form_n")
    counted = materialize(counted, "forms")
    ends = roots(counted.where("form IS NOT NULL"))
    out = counted.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, times: int = TIMES) -> DataFrame:
    """Vocabulary of ``docs`` and the variants in it, see :func:`vocabulary` and :func:`variants`.

    Null and empty texts have no words; null and repeated ids and repeated rows count as they are; other columns are ignored; an
    empty table gives an empty result. Words may be of any length.
    """
    return variants(vocabulary(docs, id_col, text_col, slip=slip), times)
