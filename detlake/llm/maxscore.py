"""Exact top-k inner products by MaxScore over shards of an impact index."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .words import per_batch

#: Best candidates per query, vectors of a shard and queries of a block.
TOP, SHARD, BLOCK = 5, 2048, 256
#: Largest absolute component, after scaling, whose products are added up exactly in doubles.
EXACT = 1 << 22


class Shard:
    """Postings of one shard: a term is a dimension with a sign, its list holds the rows with such a component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.columns = np.ascontiguousarray(self.rows.T)
        self.postings = [{1: np.flatnonzero(c > 0), -1: np.flatnonzero(c < 0)} for c in self.columns]
        self.highest = np.maximum(self.columns.max(axis=1, initial=0), 0)
        self.lowest = np.minimum(self.columns.min(axis=1, initial=0), 0)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows but ``own``, by score, then id."""
        ids, columns = self.ids, self.columns
        bound = np.maximum(query * self.highest, query * self.lowest)  # the most a term can add
        by_bound = np.argsort(-bound, kind="stable")
        after = np.concatenate([np.cumsum(bound[by_bound][::-1])[::-1], [0]])  # bound of all terms from the i-th on
        # a first threshold: rows with the largest impacts of the strongest terms, scored in full
        seeds = set()
        for t in by_bound[:4]:
            v = columns[t] * np.sign(query[t])
            seeds.update(np.argpartition(-v, min(4 * k, len(v) - 1))[: 4 * k].tolist())
        seeds = np.array([s for s in seeds if ids[s] != own], np.int64)
        threshold = -np.inf
        if len(seeds) >= k:
            threshold = np.partition(self.rows[seeds] @ query, len(seeds) - k)[len(seeds) - k]
        # essential terms: without a hit in any of them a row's score stays below the threshold
        essential = int(np.searchsorted(-after, -threshold, side="right")) if np.isfinite(threshold) else len(query)
        live = np.zeros(len(ids), bool)
        if threshold <= 0 or essential >= len(query):
            live[:] = True  # rows without any positive term can still compete
        else:
            for t in by_bound[:essential]:
                if query[t]:
                    live[self.postings[t][1 if query[t] > 0 else -1]] = True
        live &= ids != own
        at = np.flatnonzero(live)
        part = np.zeros(len(at), self.rows.dtype)
        for i in range(0, len(query), 8):  # probe the others while competitive
            terms = by_bound[i : i + 8]
            part = part + query[terms] @ columns[terms][:, at]
            alive = part + after[min(i + 8, len(query))] >= threshold
            if not alive.all():
                at, part = at[alive], part[alive]
        best = np.lexsort((ids[at], -part))[:k]
        return ids[at][best], part[best]


def scaled(vector: str, scale: int) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: str) -> Column:
    """No null, NaN or infinite component, and not null itself."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = 256,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """The k highest integer inner products of every query row with all rows but itself: (query_id, rank, vec_id, score).

    Components become floor(scale * x). Ties go to the smaller id. Vectors are dealt by hash into shards of about
    ``shard`` rows and queries into blocks of about ``block``; every pair of shard and block is one small task's work, and
    shards' results are merged by a window that keeps k rows per query before the shuffle.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Shorter vectors count as padded with
    zeros. Rows that share an id are all left out for their query, and may appear several times for others. Scores are exact: where the sum
    of products might pass what doubles hold, Python's integers are used and scores are held to 64 bits.
    """
    base = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    base = materialize(
        base.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col, scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors"
    )
    size = base.agg(F.count("*"), F.sum(F.col("q").cast("long")), F.max(F.size("x"))).first()
    shards, blocks, width = max(1, -(-size[0] // shard)), max(1, -(-(size[1] or 0) // block)), size[2] or 0
    tasks = min(shards, 10_000)  # a fixed number, or small shards would be merged into few tasks

    def dealt(rows: DataFrame, n: int, seed: int, name: str) -> DataFrame:
        return rows.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "id", "x"), F.lit(n)))

    members = F.collect_list(F.struct("id", "x"))
    index = dealt(base, shards, 1, "shard").repartition(tasks, "shard").groupBy("shard").agg(members.alias("rows"))
    asked = dealt(base.where("q"), blocks, 2, "block").groupBy("block").agg(members.alias("queries"))
    asked = asked.select("block", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    work = index.join(asked.repartition(tasks, "shard"), "shard").sortWithinPartitions("shard")

    def matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        ids, x = rows.values.field("id").to_numpy(), rows.values.field("x")
        length = x.value_lengths().to_numpy()
        out = np.zeros((len(ids), width))
        out[np.arange(width) < length[:, None]] = x.flatten().to_numpy()
        # two components of this size, times the width, are still told apart by doubles
        if out.size and np.abs(out).max() > min(EXACT, isqrt((1 << 53) // max(width, 1))):
            out = np.array([[int(v) for v in r] for r in out], object)
        return ids, out

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        known, built = None, None
        for s, rows, queries in zip(b.column("shard").to_pylist(), b.column("rows"), b.column("queries"), strict=True):
            qids, asks = matrix(queries)
            if s != known:
                plain = matrix(rows)
                known, built = s, (None if plain[1].dtype == object else Shard(*plain), plain)
            found, (ids, mat) = built
            if mat.dtype == object or asks.dtype == object:
                for q, a in zip(qids.tolist(), asks, strict=True):
                    scores = [(-sum(int(x) * int(y) for x, y in zip(a, m, strict=True)), i) for i, m in zip(ids.tolist(), mat, strict=True) if i != q]
                    for v, i in sorted(scores)[:k]:
                        out["query_id"].append(q), out["vec_id"].append(i), out["score"].append(max(-(1 << 63), min((1 << 63) - 1, -v)))
                continue
            for q, a in zip(qids.tolist(), asks, strict=True):
                who, score = found.top(q, a, k)
                out["query_id"] += [q] * len(who)
                out["vec_id"] += who.tolist()
                out["score"] += score.astype(np.int64).tolist()
        return {n: pa.array(v, pa.int64()) for n, v in out.items()}

    best = per_batch(work.select("shard", "rows", "queries"), run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
