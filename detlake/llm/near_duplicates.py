"""Near-duplicate groups by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .words import NO_ID, Rolling, as_long, blobs, known_id, mix, packed, per_batch, present, unpack, word_hashes, words

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: Sketch coordinates and bands. A pair at 0.75 misses all 32 bands of four coordinates with probability 6e-6, at 0.8 with 5e-8.
COORDINATES, BANDS = 128, 32
#: Bits of the longer sketch, a multiple of 64, and shingles of a block of a bucket, on the average.
BITS, BLOCK = 1024, 1 << 18


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of the lower-cased text; a shorter text is one shingle."""
    hashes = word_hashes(words(text.lower()))
    if not len(hashes):
        return hashes
    return np.unique(Rolling(hashes).windows(min(size, len(hashes))))


def sketch(items: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: every coordinate is filled.

    Round i throws each item into a hashed bin with a value from the i-th interval; a bin keeps its smallest value, so
    later rounds only fill what is still empty. After ``coordinates`` random rounds, round ``coordinates + j`` puts all
    items into bin j, which fills whatever is left. The rounds stop when no bin is empty.
    """
    full = np.iinfo(np.uint64).max
    out = np.full(coordinates, full, np.uint64)
    for i in range(2 * coordinates):
        x = mix(items + np.uint64((i + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        value = (x >> np.uint64(16)) | np.uint64(i << 48)
        if i < coordinates:
            np.minimum.at(out, (x % np.uint64(coordinates)).astype(np.int64), value)
        else:
            out[i - coordinates] = min(out[i - coordinates], value.min())
        if out.max() != full:
            return out
    return out


def band_keys(sketched: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band, the band's number included."""
    rows = sketched.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(rows.shape[1]):
        key = mix(key ^ rows[:, j]) * np.uint64(0xE7037ED1A0B428DB)
    return key


def _sketched(docs: DataFrame, shingle: int, coordinates: int, bands: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        size, hi, lo, keys = [], [], [], []
        for text in blobs(b, "data"):
            items = shingle_set(text, shingle)
            whole = xxhash.xxh3_128_digest(items.tobytes())
            size.append(len(items))
            hi.append(int.from_bytes(whole[:8], "big", signed=True))
            lo.append(int.from_bytes(whole[8:], "big", signed=True))
            keys.append(as_long(band_keys(sketch(items, coordinates), bands)) if len(items) else None)
        return {
            "d": b.column("d"), "n": pa.array(size, pa.int64()), "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()),
            "keys": pa.array(keys, pa.list_(pa.int64())),
        }

    return per_batch(docs, run, "d long, n long, hi long, lo long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full shingle sets are similar enough."""
    a = texts.select(F.col("d").alias("u"), F.col("data").alias("a"))
    b = texts.select(F.col("d").alias("v"), F.col("data").alias("b"))
    both = pairs.join(a, "u").join(b, "v")

    def check(x: pa.RecordBatch) -> dict:
        keep, last, known = [], None, None
        for one, two in zip(blobs(x, "a"), blobs(x, "b"), strict=True):
            if two != last:  # rows arrive sorted by v
                last, known = two, shingle_set(unpack(two), shingle)
            mine = shingle_set(unpack(one), shingle)
            same = len(np.intersect1d(mine, known, assume_unique=True))
            keep.append(same > 0 and 100 * same >= percent * (len(mine) + len(known) - same))
        keep = pa.array(keep, pa.bool_())
        return {"u": x.column("u").filter(keep), "v": x.column("v").filter(keep)}

    return per_batch(both.select("u", "v", "a", "b"), check, "u long, v long")


def _signed(texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """One bit of each of ``bits`` further sketch coordinates, 64 to a long, and the shingle set itself, as bytes."""

    def run(b: pa.RecordBatch) -> dict:
        sets = [shingle_set(unpack(t), shingle) for t in blobs(b, "data")]
        rows = [mix(sketch(mix(items), bits)) & np.uint64(1) for items in sets]
        packed_rows = [as_long(np.packbits(r.astype(np.uint8)).view(np.uint64)) for r in rows]
        return {"rep": b.column("d"), "bits": pa.array(packed_rows, pa.list_(pa.int64())), "items": pa.array([x.tobytes() for x in sets], pa.binary())}

    return per_batch(texts, run, "rep long, bits array<long>, items binary")


def _close(bits: int, percent: int) -> int:
    """Equal bits that a pair at the threshold has, less 4.5 standard deviations (3 pairs in a million fall below)."""
    p = (1 + percent / 100) / 2
    return int(bits * p - 4.5 * (bits * p * (1 - p)) ** 0.5)


class _Block:
    """Some members of one bucket."""

    def __init__(self, members: pa.StructScalar):
        rows = members.values
        self.rep, self.n, self.component = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "component"))
        self.bits, self.keys = (rows.field(c).flatten().to_numpy().view(np.uint64).reshape(len(rows), -1) for c in ("bits", "keys"))
        self._items = rows.field("items")

    def items(self, i: int) -> np.ndarray:
        return np.frombuffer(self._items[i].as_buffer(), np.uint64)


def _block_links(key: int, one: _Block, two: _Block, same: bool, apart: int, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as join the components that belong together.

    Pairs as close as the bits of the threshold demand are compared on their full sets, in the first bucket they share. Once two
    components are joined, their other pairs need no look.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    found = []
    for a in range(0, len(one.rep), 32):
        some = slice(a, a + 32)
        differ = np.bitwise_count(one.bits[some, None] ^ two.bits[None]).sum(axis=2, dtype=np.int64)
        x, y = one.n[some, None], two.n[None]
        near = (differ <= apart) & (one.component[some, None] != two.component[None]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        for p, q in zip(*np.nonzero(near), strict=True):
            i, j = a + int(p), int(q)
            if same and i >= j:
                continue
            c, d = root(int(one.component[i])), root(int(two.component[j]))
            if c == d:
                continue
            shared = np.intersect1d(one.keys[i], two.keys[j], assume_unique=True)
            if shared.view(np.int64).min() != key:
                continue
            mine, other = one.items(i), two.items(j)
            equal = len(np.intersect1d(mine, other, assume_unique=True))
            if equal and 100 * equal >= percent * (len(mine) + len(other) - equal):
                parent[max(c, d)] = min(c, d)
                found.append((int(one.rep[i]), int(two.rep[j])))
    return found


def _links_between(left: DataFrame, signs: DataFrame, bits: int, percent: int, size: int) -> DataFrame:
    """``(u, v)``: links between the components of each bucket in ``left`` (key, rep, n, component).

    The members of a bucket are dealt to blocks of about ``size`` shingles, and each two blocks of a bucket are compared where they
    meet. A link leaves that place only if it joins two components there, so what is passed on grows with the members, however
    many pairs of a bucket are nearly similar.
    """
    # a bucket's members know from one row per bucket into how many blocks they go
    parts = left.groupBy("key").agg(F.ceil(F.sum(F.col("n") + 64) / size).alias("parts"))
    wide = left.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).join(signs, "rep")
    member = F.struct("rep", "n", "component", "bits", "keys", "items")
    blocks = wide.groupBy("key", "part").agg(F.collect_list(member).alias("one"), F.max("parts").alias("parts"))
    blocks = materialize(blocks, "blocks")
    several = blocks.where("parts > 1").drop("parts")
    other = several.select(F.col("key").alias("k"), F.col("part").alias("p"), F.col("one").alias("two"))
    crossed = several.join(other, (F.col("key") == F.col("k")) & (F.col("part") < F.col("p"))).select("key", "one", "two")
    apart = bits - _close(bits, percent)

    def pairs(df: DataFrame) -> DataFrame:
        def run(b: pa.RecordBatch) -> dict:
            links = []
            for i, key in enumerate(b.column("key").to_pylist()):
                one = _Block(b.column("one")[i])
                two = _Block(b.column("two")[i]) if "two" in b.schema.names else one
                links += _block_links(key, one, two, one is two, apart, percent)
            return {"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())}

        return per_batch(df, run, "u long, v long")

    return pairs(blocks.where(F.size("one") > 1).select("key", "one")).unionByName(pairs(crossed))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    coordinates: int = COORDINATES, bands: int = BANDS, bits: int = BITS, block: int = BLOCK,
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` per row of ``docs``: documents linked, directly or through others, by
    100 * intersection >= percent * union of their shingle sets.

    Documents with equal sets are one class, found by an aggregate, and their smallest id stands for the class. Members of
    each band bucket are verified against the bucket's smallest member. If a bucket still holds several components after that, its
    members meet in blocks of about ``block`` shingles: pairs across components whose bits of a longer sketch are as close as the
    threshold demands are verified on their full sets there, each in the first bucket the two share.

    Null or empty texts and texts without words have an empty set and stay alone. Rows that share an id are one document,
    with the links of all their texts. A null id takes no part: component null, kept. Extra columns are ignored.
    """
    base = docs.select(known_id(id_col).alias("d"), present(text_col).alias("data"))
    rows = materialize(_sketched(base, shingle, coordinates, bands), "sketches")
    linked = rows.where(f"n > 0 AND d <> {NO_ID}")
    classes = materialize(linked.groupBy("hi", "lo").agg(F.min("d").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    banded = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = materialize(
        classes.select("rep", F.explode("keys").alias("key")).groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("most"))
        .where("lead < most").drop("most"),
        "buckets",
    )
    members = materialize(banded.join(shared.hint("shuffle_hash"), "key"), "members")
    wanted = members.select(F.col("rep").alias("d")).distinct()
    texts = materialize(packed(base, "data").join(wanted, "d"), "texts")
    pairs = materialize(members.where("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct(), "pairs")
    # ids of one document with several texts and of classes that share a document are links too
    links = materialize(_verified(pairs, texts, shingle, percent), "verified")
    same_id = linked.select("d", "hi", "lo").distinct().join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).where("d <> rep")
    doubled = materialize(linked.select("d", "hi", "lo").distinct().groupBy("d").count().where("count > 1").select("d"), "doubled")
    links = links.unionByName(same_id.join(doubled, "d", "left_semi").select(F.col("d").alias("u"), F.col("rep").alias("v")))
    labels = materialize(components(links), "labels")
    now = materialize(
        members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "now"
    )
    mixed = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    left = materialize(now.join(materialize(mixed, "mixed").hint("shuffle_hash"), "key", "left_semi"), "left")
    if not left.isEmpty():
        ids = materialize(left.select("rep").distinct(), "ids")
        signs = _signed(texts.join(ids.withColumnRenamed("rep", "d"), "d", "left_semi"), shingle, bits)
        signs = materialize(signs.join(classes.select("rep", "keys"), "rep"), "signs")
        links = materialize(links.unionByName(_links_between(left.drop("lead"), signs, bits, percent, block)), "verified")
        labels = materialize(components(links), "labels")
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component")
    )
    named = materialize(named, "named")
    own = rows.join(named.hint("shuffle_hash"), ["hi", "lo"], "left")
    component = F.when(F.col("d") != NO_ID, F.coalesce("component", "d"))
    return own.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("d") == component, F.lit(True)).alias("kept"),
    )
