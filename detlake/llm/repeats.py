"""Substring deduplication: seed and extend over winnowed anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Rolling, as_long, blobs, joined, known_id, mix, packed, per_batch, present, unpack, word_hashes, words

#: Words of a repeat, and words of the seeds that are hashed to choose anchors.
WINDOW, SEED = 20, 6


def anchor_runs(text: bytes, window: int, seed: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share an anchor: first window, number of windows, seed hash, hash of the extended seed.

    A window's anchor is the smallest seed hash inside it, the first one if there are several: equal windows have equal
    anchors at equal offsets. The extension reaches from the first to the last word of the run's windows, so two runs
    are equal exactly if the seeds match and all words that can be covered from them do.
    """
    rolling = Rolling(word_hashes(words(text)))
    n = rolling.n - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return rolling, z, z, z.view(np.uint64), z.view(np.uint64)
    seeds = rolling.windows(seed)
    spot = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.diff(spot, prepend=-1))
    count = np.diff(first, append=n)
    at = spot[first]
    shape = mix((count.astype(np.uint64) << np.uint64(32)) | (at - first).astype(np.uint64))
    return rolling, first, count, seeds[at], rolling.stretches(first, first + count + window - 1) ^ shape


def _anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """One row per run: seed and extension hash, document, text hash, and first window and window count in one long."""

    def find(b: pa.RecordBatch) -> dict:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for d, t, text in zip(blobs(b, "d"), blobs(b, "t"), blobs(b, "data"), strict=True):
            _, first, count, seeds, blocks = anchor_runs(text, window, seed)
            for o, x in zip(out, (as_long(seeds), as_long(blocks), np.full(len(first), d), np.full(len(first), t), first * 32 + count), strict=True):
                o.append(x.astype(np.int64, copy=False))
        return dict(zip(("seed", "block", "d", "t", "place"), (joined(o, np.int64) for o in out), strict=True))

    return per_batch(docs, find, "seed long, block long, d long, t long, place long")


def _windows(work: DataFrame, window: int, seed: int) -> DataFrame:
    """Single windows of the runs listed in ``fine``."""

    def cut(b: pa.RecordBatch) -> dict:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for d, t, text, fine in zip(blobs(b, "d"), blobs(b, "t"), blobs(b, "data"), blobs(b, "fine"), strict=True):
            rolling, first, count, seeds, _ = anchor_runs(unpack(text), window, seed)
            wanted = np.isin(first, np.array(fine, np.int64) >> 5)
            times = count[wanted]
            start = np.repeat(first[wanted] - np.cumsum(times) + times, times) + np.arange(times.sum())
            hashes = rolling.stretches(start, start + window)
            for o, x in zip(out, (np.repeat(as_long(seeds)[wanted], times), as_long(hashes), np.full(len(start), d), np.full(len(start), t), start), strict=True):
                o.append(x.astype(np.int64, copy=False))
        return dict(zip(("seed", "window", "d", "t", "start"), (joined(o, np.int64) for o in out), strict=True))

    return per_batch(work, cut, "seed long, window long, d long, t long, start long")


def covered(text: bytes, places: list[int], starts: list[int], window: int) -> tuple[list[bytes], np.ndarray]:
    """The words and which of them lie in a repeated window: listed runs and windows, and repeats inside the text."""
    found = words(text)
    own = Rolling(word_hashes(found)).windows(window)
    again = np.ones(len(own), bool)
    again[np.unique(own, return_index=True)[1]] = False
    p = np.array(places, np.int64)
    start = np.concatenate([p >> 5, np.array(starts, np.int64), np.flatnonzero(again)])
    end = np.concatenate([(p >> 5) + (p & 31) - 1, np.array(starts, np.int64), np.flatnonzero(again)]) + window
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return found, np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts earlier (smaller id, or same text further left).

    Returns the columns of ``docs``, with the kept words in ``text_col`` (joined by one space; a text that loses
    nothing stays as it is), and ``n_words``, ``n_removed``, ``spans`` (removed word ranges) in front of them inside
    the struct column ``repeat``.

    Seeds are joined in three steps that never form pairs: seeds seen in one document only are dropped; runs equal to
    a run of an earlier document are removed as a whole; where one seed has several extensions, the first holders'
    windows are compared one by one. All groups are aggregates that combine before the shuffle, and hot keys only occur
    on the side of a join that can be split.

    Null and empty texts: no words, nothing removed. Null ids count as the largest id; rows that share an id do not
    remove words from each other, a text's own repeats go. Texts under one id are told apart by a 64-bit hash, and equal ones
    share one list of places, each of them once. Other columns pass through, whatever their names.
    ``window`` must not be over 31 words beyond the seed.
    """
    if not 0 < seed <= window < seed + 31:
        raise ValueError("window must have at least the words of the seed and less than 31 more")
    base = docs.select(
        known_id(id_col).alias("d"),
        F.xxhash64(F.col(text_col)).alias("t"),
        present(text_col).alias("data"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.col(text_col).isNull().alias("none")).alias("rest"),
    )
    texts = base.select("d", "t", "data")
    anchors = _anchors(texts, window, seed)
    shared = materialize(
        anchors.groupBy("seed").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("seed"), "seeds"
    )
    kept = materialize(anchors.join(shared.hint("shuffle_hash"), "seed", "left_semi"), "anchors")
    blocks = materialize(kept.groupBy("seed", "block").agg(F.min("d").alias("holder")), "blocks")
    several = materialize(blocks.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed", F.lit(True).alias("mixed")), "mixed")
    blocks = materialize(blocks.join(several, "seed", "left"), "holders")
    work = materialize(
        kept.join(blocks.hint("shuffle_hash"), ["seed", "block"])
        .where("holder < d OR mixed")
        .groupBy("d", "t")
        .agg(
            F.collect_set(F.when(F.col("holder") < F.col("d"), F.col("place"))).alias("whole"),
            F.collect_set(F.when(F.col("holder") == F.col("d"), F.col("place"))).alias("fine"),
        ),
        "work",
    )
    single = materialize(_windows(packed(texts, "data").join(work.where("size(fine) > 0"), ["d", "t"]), window, seed), "windows")
    firsts = materialize(
        single.groupBy("seed", "window").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").drop("hi"), "firsts"
    )
    starts = (
        single.join(firsts.hint("shuffle_hash"), ["seed", "window"]).where("lo < d").groupBy("d", "t").agg(F.collect_set("start").alias("starts"))
    )
    marked = packed(base, "data").join(work.select("d", "t", "whole"), ["d", "t"], "left").join(starts, ["d", "t"], "left")

    def cut(b: pa.RecordBatch) -> dict:
        text, total, gone, spans = [], [], [], []
        for data, runs, single in zip(blobs(b, "data"), blobs(b, "whole"), blobs(b, "starts"), strict=True):
            data = unpack(data)
            found, off = covered(data, runs or [], single or [], window)
            n = int(off.sum())
            edge = np.flatnonzero(np.diff(off, prepend=False, append=False)).tolist()
            text.append(b" ".join([w for w, x in zip(found, off.tolist(), strict=True) if not x]) if n else data)
            total.append(len(found))
            gone.append(n)
            spans.append([{"start": a, "end": z} for a, z in zip(edge[::2], edge[1::2], strict=True)])
        return {
            "rest": b.column("rest"), "text": pa.array(text, pa.binary()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }

    rest = base.schema["rest"].dataType.simpleString()
    out = per_batch(
        marked.select("rest", "data", "whole", "starts"), cut,
        f"rest {rest}, text binary, n_words long, n_removed long, spans array<struct<start:long,end:long>>",
    )
    cols = [
        (F.when(~F.col("rest.none"), F.col("text").cast("string")) if c == text_col else F.col(f"rest.c{i}")).alias(c)
        for i, c in enumerate(docs.columns)
    ]
    return out.select(F.struct("n_words", "n_removed", "spans").alias("repeat"), *cols)
