"""Token ids in binary shards, compressed one document at a time with a shared zstandard dictionary."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from hashlib import sha256
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .words import bounded_sample, known_id, present

#: Bytes of a shard's documents before a new shard begins, words a task remembers, and the dictionary's size and sample.
SHARD_BYTES, REMEMBERED, DICTIONARY_BYTES, SAMPLED_ROWS = 4 << 20, 400_000, 64 << 10, 1000
#: First bytes of a shard; then the dictionary's sha256, the number of documents, and their index.
MAGIC = b"TOKENS01"
_HEAD = struct.Struct("<8s32sQ")
#: Index entry: id (NO_ID for null), ids of the documents before it in its part, number of ids, offset and size of its frame.
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("n", "<i8"), ("offset", "<i8"), ("size", "<i8")])


# How byte-level tokenizers write a byte: printable ones as themselves, the others in order from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Encodes texts word by word. The tokenizer drops white space and never joins across it, so a word's ids do not depend
    on its neighbours; words seen before are looked up, new ones are encoded together, cut apart at a special token."""

    def __init__(self, path: str, cut: str = "<|endoftext|>"):
        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.cut_id = cut, self.tokenizer.token_to_id(cut)
        self.kind = np.dtype("H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I")
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _simple(self, word: bytes) -> bytes | None:
        """Ids of a Latin word with punctuation behind it: the tokenizer makes two pieces of it, whose ids can be kept apart.

        The model's own merges are asked for the letters, in the form that normalisation and byte mapping give them.
        """
        core = word.rstrip(b".,;:!?")
        ids = self.cores.get(core)
        if ids is None:
            if core.isalpha():  # ASCII letters
                mapped = core.lower().decode()
            else:
                letters = normalize("NFC", core.decode("utf-8", "replace")).lower()
                if not letters.isalpha() or max(letters) >= "\u0250":  # beyond Latin, lower case may depend on context
                    return None
                mapped = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = array(self.kind.char, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            if len(self.cores) < REMEMBERED:
                self.cores[core] = ids
        tail = word[len(core) :]
        if tail:
            if tail not in self.cores:
                self.cores[tail] = self._raw(tail.decode()).tobytes()
            ids += self.cores[tail]
        return ids

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, new = {}, []
        for w in words:
            ids = self._simple(w)
            if ids is None:
                new.append(w)
            else:
                out[w] = ids
        for a in range(0, len(new), 2000):
            part = [w.decode("utf-8", "replace") for w in new[a : a + 2000]]
            odd = [i for i, w in enumerate(part) if self.cut in w]
            ids = self._raw(self.cut.join("" if self.cut in w else w for w in part))
            ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
            begins = np.concatenate([[0], ends[:-1] + 1])
            for w, x, y in zip(new[a : a + 2000], begins.tolist(), ends.tolist(), strict=True):
                out[w] = ids[x:y].tobytes()
            for i in odd:
                out[new[a + i]] = self._raw(part[i]).tobytes()
        return out

    def encode(self, texts: list[bytes], last: int) -> Iterator[bytes]:
        """The ids of each text and the end id, as little-endian integers of ``kind``."""
        end = np.array([last], self.kind).tobytes()
        look = self.known.__getitem__
        for a in range(0, len(texts), 1000):  # new words of so many texts are encoded together
            words = [t.split() for t in texts[a : a + 1000]]
            new = list(set().union(*words) - self.known.keys())
            self.known.update(self._learn(new))
            for ws in words:
                yield b"".join(map(look, ws)) + end
            if len(self.known) > REMEMBERED:  # early words are the frequent ones: they stay
                for w in new:
                    del self.known[w]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker; its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shard(entries: list[tuple[int, int, int]], frames: list[bytes], digest: bytes) -> bytes:
    index = np.zeros(len(entries), ENTRY)
    for name, values in zip(("doc_id", "start", "n"), zip(*entries, strict=True), strict=True):
        index[name] = values
    index["size"] = [len(f) for f in frames]
    index["offset"] = np.cumsum(index["size"]) - index["size"]
    return _HEAD.pack(MAGIC, digest, len(entries)) + index.tobytes() + b"".join(frames)


class ShardReader:
    """Reads one shard; a single document is decompressed without touching the others."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, n = _HEAD.unpack_from(data)
        if magic != MAGIC or digest != sha256(dictionary).digest():
            raise ValueError("not a token shard, or written with another dictionary")
        self.index = np.frombuffer(data, ENTRY, n, _HEAD.size)
        self.body = memoryview(data)[_HEAD.size + n * ENTRY.itemsize :]
        self._frames = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def raw(self, i: int) -> bytes:
        e = self.index[i]
        return self._frames.decompress(self.body[e["offset"] : e["offset"] + e["size"]])

    def ids(self, i: int) -> np.ndarray:
        data = self.raw(i)
        return np.frombuffer(data, "<u2" if len(data) == 2 * self.index[i]["n"] else "<u4").astype(np.uint32)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, text_col: str = "text", rows: int = SAMPLED_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary from the serialized ids of ``rows`` texts at most, the first by hash. Of each sampled text the whole id array
    is one sample. Too few samples: an empty dictionary."""
    sample = docs.where(F.col(text_col).isNotNull()).select(present(text_col).alias("data")).where(F.length("data").between(1, 1 << 16))
    sample = bounded_sample(sample, rows, "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder(tokenizer).encode(b.column(0).to_pylist(), end_id), pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
    parts: int | None = None,
) -> None:
    """Encode every text, end it with ``end_id`` and write shards in ascending id order below ``path``.

    ``path/shards`` holds one row per shard (part, first id, ids in it, file bytes), written by Spark so that a retried task
    leaves nothing behind; ``path/dictionary`` holds the dictionary. Rows are sorted by range of id, hash of text and place, so
    no task sees more than its range, even if all rows share an id and a text; a text is compressed on its own. Null ids come
    last, rows that share an id follow by hash of their text; null texts are empty and have the end id only.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id, text_col)
    spark.sql("SELECT :d AS dictionary", args={"d": bytearray(dictionary)}).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)
    base = docs.select(known_id(id_col).alias("d"), present(text_col).alias("data"))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = base.select("*", F.xxhash64("data").alias("h"), F.monotonically_increasing_id().alias("row"))
    ranged = placed.repartitionByRange(n, "d", "h", "row").sortWithinPartitions("d", "h", "data").select("d", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = sha256(held.value).digest()
        codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None, write_checksum=False, write_dict_id=False)
        own = encoder(tokenizer)
        entries, frames, size, before, part = [], [], 0, 0, TaskContext.get().partitionId()  # parts are numbered in ascending order

        def shard() -> pa.RecordBatch:
            row = {"part": part, "doc_id": entries[0][0], "n": sum(e[2] for e in entries), "shard": write_shard(entries, frames, digest)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("shard", pa.binary())]))

        for b in batches:
            for d, ids in zip(b.column("d").to_pylist(), own.encode(b.column("data").to_pylist(), end_id), strict=True):
                frame = codec.compress(ids)
                entries.append((d, before, len(ids) // own.kind.itemsize))
                frames.append(frame)
                before += entries[-1][2]
                size += len(frame)
                if size >= shard_bytes:
                    yield shard()
                    entries, frames, size = [], [], 0
        if entries:
            yield shard()

    ranged.mapInArrow(run, "part long, doc_id long, n long, shard binary").write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of all documents, read from the files; ``ids`` is binary, little-endian unsigned 32-bit integers.

    The parts' positions come from a running sum over one row per part, a table as small as the number of write tasks.
    """
    shards = spark.read.parquet(f"{path}/shards")
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column("base").to_pylist(), b.column("shard"), strict=True):
                reader = ShardReader(data.as_py(), dictionary.value)
                starts = pa.array(reader.index["start"] + base)
                for a in range(0, len(reader.index), 256):
                    some = range(a, min(a + 256, len(reader.index)))
                    ids = pa.array([reader.ids(i).tobytes() for i in some], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(reader.index["doc_id"][a : a + 256]), starts[a : a + 256], ids], ["doc_id", "start", "ids"])

    out = shards.select("part", "shard").join(F.broadcast(parts), "part").select("base", "shard")
    none = (1 << 63) - 1
    read = out.mapInArrow(run, "doc_id long, start long, ids binary")
    return read.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
