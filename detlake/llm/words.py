"""Words, rolling hashes and Arrow batches shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Stands for a null id inside the operators; results carry the null again.
NO_ID = (1 << 63) - 1

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` cuts at exactly these six characters."""
    return data.split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), 4096)
        for name, base in (("_powers", BASE), ("_inverses", INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            globals()[name] = np.cumprod(full)


class Rolling:
    """Hashes of any stretch of a word sequence, from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        _grow(self.n)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * _powers[: self.n], out=self.prefix[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every stretch of ``size`` words."""
        m = self.n - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[size:] - self.prefix[:m]) * _inverses[:m])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * _inverses[start])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def present(text: str | Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def known_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; it returns the columns of the result by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = fn(b)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], list(cols))

    return df.mapInArrow(run, schema)


def joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).to_pylist()


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its binary ``column`` compressed, to move texts through a shuffle in a third of their size."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = pa.array([small.compress(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of ``key``; all of them if there are no more.

    A share a little larger than needed is cut out by the hash before anything is sorted, so no task sends more than its part.
    """
    n = df.count()
    order = F.xxhash64(*key)
    if n > rows:
        share = min(1.0, 1.2 * rows / n + 1e-6)
        df = df.where(F.pmod(F.xxhash64(F.lit(3), *key), F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.orderBy(order, *key).limit(rows)
