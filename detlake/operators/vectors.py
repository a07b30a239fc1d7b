"""Pairs of similar vectors inside groups, compared as matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block at most, on the average.
BLOCK = 512


def _units(col: pa.ListScalar | pa.Array, n: int) -> np.ndarray:
    m = np.array(col, dtype=np.float64).reshape(n, -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def similar_pairs(df: DataFrame, keys: Sequence[str], uid: str, column: str, limit: float, block: int = BLOCK) -> DataFrame:
    """``(keys, uid, other, dist)``: pairs of a group whose cosine distance is at most ``limit``, ``uid`` below ``other``.

    The angle between two vectors is at least the difference of their angles to a fixed direction. So each group is cut into bands of
    that angle, a third of the largest allowed angle wide, and only bands up to three apart are compared; the least and the
    largest angle of two blocks rule out more. Bands with more than ``block`` vectors are divided by hash. Two blocks are multiplied as
    matrices, so a hot group becomes many small products, and no task holds more than two blocks.

    Vectors that are null, of length zero, or hold a missing or infinite number have no partners; neither have rows without key or
    id. Rows that share an id are compared with others, not with each other. All vectors of a group have one length.
    """
    keys = list(keys)
    angle = math.acos(max(-1.0, min(1.0, 1 - limit)))
    width = max(angle / 3, 1e-6)
    v = F.transform(column, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    total = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x)
    d = df.select(*keys, F.col(uid).alias("_id"), v.alias("_v"))
    for c in (*keys, "_id"):
        d = d.filter(F.col(c).isNotNull())
    d = d.filter(F.col("_v").isNotNull()).withColumn("_size", size).filter((F.col("_size") > 0) & (F.col("_size") < float("inf")))
    cos = total / (F.col("_size") * F.sqrt(F.size("_v").cast("double")))
    d = d.withColumn("_t", F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))
    d = d.withColumn("_band", F.floor(F.col("_t") / width)).drop("_size")
    # one row per band; vectors know from it into how many blocks their band is divided
    bands = d.groupBy(*keys, "_band").agg(F.ceil(F.count("*") / block).alias("_parts"))
    d = d.join(bands, [*keys, "_band"]).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    item = F.struct("_id", "_t", "_v")
    blocks = d.groupBy(*keys, "_band", "_part").agg(F.collect_list(item).alias("_rows"))
    blocks = blocks.select(
        *keys, "_band", "_part", F.array_min("_rows._t").alias("_lo"), F.array_max("_rows._t").alias("_hi"),
        F.col("_rows._id").alias("_ids"), F.flatten("_rows._v").alias("_flat"),
    )
    near = F.explode(F.sequence(F.col("_band"), F.col("_band") + 3))
    left = blocks.withColumn("_at", near)
    right = blocks.select(*[F.col(c).alias(f"b{c}") for c in blocks.columns])
    on = F.col("_at") == F.col("b_band")
    for k in keys:
        on = on & (F.col(k) == F.col(f"b{k}"))
    # each pair of blocks once; a margin for the rounding of the angles
    on = on & ((F.col("_band") < F.col("b_band")) | (F.col("_part") <= F.col("b_part")))
    on = on & (F.greatest(F.col("b_lo") - F.col("_hi"), F.col("_lo") - F.col("b_hi")) <= angle + 1e-7)
    same = (F.col("_band") == F.col("b_band")) & (F.col("_part") == F.col("b_part"))
    pairs = left.join(right, on).select(*keys, "_ids", "_flat", F.col("b_ids").alias("_ids2"), F.col("b_flat").alias("_flat2"), same.alias("_same"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {uid} {kinds[uid]}, other {kinds[uid]}, dist double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                one, two = cols["_ids"][i].values, cols["_ids2"][i].values
                x, y = _units(cols["_flat"][i].values, len(one)), _units(cols["_flat2"][i].values, len(two))
                dist = np.maximum(0.0, 1.0 - x @ y.T)
                close = dist <= limit
                if cols["_same"][i].as_py():
                    close = np.triu(close, 1)
                p, q = np.nonzero(close)
                ids, others = one.take(pa.array(p)), two.take(pa.array(q))
                less = pa.compute.less(ids, others)
                differ = pa.compute.not_equal(ids, others)
                low, high = pa.compute.if_else(less, ids, others), pa.compute.if_else(less, others, ids)
                own = [pa.array([cols[k][i].as_py()] * len(p), cols[k].type) for k in keys]
                out = pa.RecordBatch.from_arrays([*own, low, high, pa.array(dist[p, q])], [*keys, uid, "other", "dist"])
                out = out.filter(differ)
                if out.num_rows:
                    yield out

    return pairs.mapInArrow(run, schema)
