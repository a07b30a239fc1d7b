"""Best-fit packing of documents into fixed-size sequences, under source and duplicate conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import blobs, per_batch, present

#: Words of a bin, documents of one source in a bin at most, and documents packed together on average.
CAPACITY, PER_SOURCE, SHARD = 4096, 4, 8192


class Bins:
    """Open bins ordered by what is left in them. Each carries a bitmap of its duplicate clusters and, per level, a bitmap
    of the sources it holds at least that often."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def place(self, need: int, source: int, cluster: int) -> int:
        """Put a piece into the tightest compatible bin, searching upwards from the smallest sufficient residual."""
        if need == self.capacity:  # fills a bin alone
            return self._open(0, source, cluster)
        for at in range(bisect_left(self.order, (need, -1)), len(self.order)):
            left, b = self.order[at]
            if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                del self.order[at]
                self._add(b, left - need, source, cluster)
                return b
        return self._open(self.capacity - need, source, cluster)

    def _open(self, left: int, source: int, cluster: int) -> int:
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        b = len(self.clusters) - 1
        self._add(b, left, source, cluster)
        return b

    def _add(self, b: int, left: int, source: int, cluster: int) -> None:
        self.clusters[b] |= cluster
        for level, held in enumerate(self.sources[b]):
            if not held & source:
                self.sources[b][level] |= source
                break
        if left:
            insort(self.order, (left, b))


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int, int | None]]:
    """``(key, words, source, cluster)`` rows, any order -> ``(row, start, length, bin)``; the longest pieces go first, ties by key.

    Pieces of one document conflict with each other like duplicates do. A row without words has no bin.
    """
    sources: dict = {}
    clusters: dict = {}
    often = Counter(r[3] for r in rows)
    pieces = [(min(capacity, r[1] - a), i, a) for i, r in enumerate(rows) for a in range(0, r[1], capacity)]
    pieces.sort(key=lambda p: (-p[0], rows[p[1]][0], p[2]))
    bins, out = Bins(capacity, per_source), [(i, 0, 0, None) for i, r in enumerate(rows) if not r[1]]
    for length, i, start in pieces:
        _, total, source, cluster = rows[i]
        bit = 1 << sources.setdefault(source, len(sources))
        alike = 1 << clusters.setdefault(cluster, len(clusters)) if often[cluster] > 1 or total > capacity else 0
        out.append((i, start, length, bins.place(length, bit, alike)))
    return out


def measured(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Id, source, number of words and duplicate cluster (hash of the lower-cased words) of each text."""

    def run(b: pa.RecordBatch) -> dict:
        words = [t.lower().split() for t in blobs(b, "data")]
        cluster = pa.array([int.from_bytes(xxhash.xxh3_64_digest(b" ".join(w)), "big", signed=True) for w in words], pa.int64())
        return {"doc_id": b.column("doc_id"), "source": b.column("source"), "n_words": pa.array(map(len, words), pa.int64()), "cluster": cluster}

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), present(text_col).alias("data"))
    return per_batch(inner, run, "doc_id long, source string, n_words long, cluster long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """Pack rows (doc_id, source, n_words, cluster) into bins of ``capacity`` words: (doc_id, piece, start, n_words, bin).

    A text longer than a bin is cut into full pieces and a rest. No bin holds two rows of one cluster, two pieces of one
    text, or more than ``per_source`` rows of one source. Rows are dealt by hash into shards of about ``shard`` rows,
    whatever their source or cluster; each shard is packed by best fit, longest first, so a hot source or cluster is spread
    evenly. Null ids, sources and clusters are values of their own kind; a text without words gets one row with a null bin;
    repeated rows are packed one by one.
    """
    pieces = materialize(pieces.select("doc_id", "source", "n_words", "cluster"), "pieces")
    n = max(1, -(-pieces.count() // shard))
    dealt = pieces.select("*", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(n)).alias("shard"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(x) else int(x) for x in rows.doc_id.astype("object")]
        sources = [None if pd.isna(x) else x for x in rows.source]
        clusters = [None if pd.isna(x) else int(x) for x in rows.cluster.astype("object")]
        order = [((i is None, i or 0, c or 0), int(w), s, c) for i, w, s, c in zip(ids, rows.n_words, sources, clusters, strict=True)]
        placed = pack_shard(order, capacity, per_source)
        return pd.DataFrame(
            {
                "doc_id": pd.array([ids[i] for i, *_ in placed], "Int64"),
                "piece": [a // capacity for _, a, _, _ in placed],
                "start": [a for _, a, _, _ in placed],
                "n_words": [w for _, _, w, _ in placed],
                "bin": pd.array([None if b is None else (int(key[0]) << 32) + b for *_, b in placed], "Int64"),
            }
        )

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n_words long, bin long")
