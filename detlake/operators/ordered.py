"""Ordered computations that stay balanced when one key holds much of the data.

A window over a key runs in one task. Here each key's rows are first cut into blocks along the order; a small table with
one row per (key, block) carries what the earlier blocks contribute, and the window runs inside a block only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocked(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Rows with their block. The joins below drop NULL keys anyway; saying so here keeps both of their inputs the same
    plan, so that Spark computes it once."""
    out = df.withColumn("_blk", block)
    for c in (*keys, "_blk"):
        out = out.filter(F.col(c).isNotNull())
    return out


_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums and maxima (current row included) per key.

    ``sums`` and ``maxima`` map new column names to existing ones. ``block`` must not decrease along ``order``.
    """
    sums, maxima = sums or {}, maxima or {}
    df = _blocked(df, keys, block)
    per_block = df.groupBy(*keys, "_blk").agg(
        *[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_b_{n}") for n, c in maxima.items()]
    )
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*_BEFORE)
    base = per_block.select(
        *keys,
        "_blk",
        *[F.coalesce(F.sum(f"_b_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_b_{n}").over(across).alias(f"_b_{n}") for n in maxima],
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(*_UPTO)
    out = df.join(base, [*keys, "_blk"])
    out = out.withColumns(
        {n: F.sum(c).over(inside) + F.col(f"_b_{n}") for n, c in sums.items()}
        | {n: F.greatest(F.max(c).over(inside), F.col(f"_b_{n}")) for n, c in maxima.items()}
    )
    return out.drop("_blk", *[f"_b_{n}" for n in (*sums, *maxima)])


def _needed(columns: Sequence[str]) -> Column:
    """True, but reads all ``columns``: two branches of a plan that both ask this want the same rows and share one shuffle of them."""
    return F.hash(*columns).bitwiseAND(F.lit(0)) == 0


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    event: dict[str, str | Column] | None = None,
    when: Column | None = None,
    sums: dict[str, Callable[[Column, Column], Column]] | None = None,
    maxima: dict[str, Column] | None = None,
    before: str = "before",
) -> DataFrame:
    """Several running values per key in one blocked pass; ``block`` must not decrease along ``order``.

    ``event`` names the fields of an event and ``when`` says which rows are events (by default all). Every row gets the struct
    ``before``, the last event of an earlier row, or NULL. ``sums`` are running sums (current row included) of a function of
    the event before and the event itself, added at events. ``maxima`` are running maxima of a column or struct.

    A stretch of rows is summed up by its first and last event, its sums and maxima; two stretches join to one by adding the
    function of the left one's last and the right one's first event. So a block needs nothing of the earlier blocks but one such state,
    and the states, one row per (key, block), are joined along each key. Rows are shuffled once, by key and block, with all
    columns of ``df``: select what is needed before.
    """
    sums, maxima = sums or {}, maxima or {}
    df = _blocked(df, keys, block)
    item = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in (event or {"_none": F.lit(0)}).items()])
    when = F.lit(event is not None) if when is None else when
    by = [*keys, "_blk"]
    inside = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_ev", F.when(when, item))
    rows = rows.withColumn("_pv", F.last("_ev", ignorenulls=True).over(inside.rowsBetween(*_BEFORE)))
    here, known = F.col("_ev").isNotNull(), F.col("_pv").isNotNull()
    rows = rows.withColumns({f"_s_{n}": F.sum(F.when(here & known, g(F.col("_pv"), F.col("_ev"))).otherwise(0)).over(inside.rowsBetween(*_UPTO)) for n, g in sums.items()})
    rows = rows.withColumns({f"_m_{n}": F.max(c).over(inside.rowsBetween(*_UPTO)) for n, c in maxima.items()})
    rows = rows.filter(_needed(df.columns))
    last = F.struct(*order)
    state = rows.groupBy(*by).agg(
        F.max(F.when(here & ~known, F.col("_ev"))).alias("_first"),
        F.max_by("_ev", F.when(here, last)).alias("_last"),
        *[F.max_by(f"_s_{n}", last).alias(f"_t_{n}") for n in sums],
        *[F.max(f"_m_{n}").alias(f"_u_{n}") for n in maxima],
    )
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*_BEFORE)
    state = state.withColumn("_carry", F.last("_last", ignorenulls=True).over(across))
    opens = {n: F.when(F.col("_first").isNotNull(), g(F.col("_carry"), F.col("_first"))).otherwise(0) for n, g in sums.items()}
    state = state.withColumns({f"_o_{n}": c for n, c in opens.items()})
    base = state.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_carry", *[f"_o_{n}" for n in sums],
        *[F.coalesce(F.sum(F.col(f"_t_{n}") + F.col(f"_o_{n}")).over(across), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_u_{n}").over(across).alias(f"_b_{n}") for n in maxima],
    )
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(by)]
    out = rows.join(base, on)
    begun = here | known
    values = {n: F.col(f"_b_{n}") + F.col(f"_s_{n}") + F.when(begun, F.col(f"_o_{n}")).otherwise(0) for n in sums}
    values |= {n: F.greatest(f"_m_{n}", f"_b_{n}") if n not in _structs(rows, maxima) else _later(f"_m_{n}", f"_b_{n}") for n in maxima}
    kept = [c for c in df.columns if c != "_blk"]
    prev = [F.coalesce("_pv", "_carry").alias(before)] if event is not None else []
    return out.select(*kept, *prev, *[v.alias(n) for n, v in values.items()])


def _structs(rows: DataFrame, maxima: dict[str, Column]) -> set[str]:
    return {n for n in maxima if rows.schema[f"_m_{n}"].dataType.typeName() == "struct"}


def _later(a: str, b: str) -> Column:
    return F.when(F.col(b).isNull() | (F.col(a) >= F.col(b)), F.col(a)).otherwise(F.col(b))


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, values: dict[str, str], when: Column | None = None
) -> DataFrame:
    """Add values of the row before, per key; NULL on the first row. ``values`` maps new names to existing columns.

    With ``when`` only rows that satisfy it count as earlier rows (the last such row is looked up).
    """
    df = _blocked(df, keys, block)
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    rank = F.struct(*[F.col(c) for c in order])
    src = df if when is None else df.filter(when)
    ends = src.groupBy(*keys, "_blk").agg(F.max_by(row, rank).alias("_end"))
    blocks = df.select(*keys, "_blk").distinct().join(ends, [*keys, "_blk"], "left") if when is not None else ends
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*_BEFORE)
    base = blocks.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(across).alias("_end"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(*_BEFORE)
    own = row if when is None else F.when(when, row)
    out = df.join(base, [*keys, "_blk"])
    out = out.withColumn("_prev", F.coalesce(F.last(own, ignorenulls=True).over(inside), F.col("_end")))
    return out.withColumns({n: F.col("_prev")[n] for n in values}).drop("_blk", "_end", "_prev")


def trailing(df: DataFrame, keys, order: str, block: Column, value: Column, n: int, name: str) -> DataFrame:
    """Add the last ``n`` values per row (its own included), oldest first.

    A row early in a block also needs values from before it. Each (key, block) hands on its last ``n - 1`` values; the last
    ``n - 1`` non-empty blocks together always hold enough of them.
    """
    d = _blocked(df, keys, block)
    item = F.struct(F.col(order).alias("o"), value.alias("v"))
    newest = Window.partitionBy(*keys, "_blk").orderBy(F.col(order).desc())
    tails = d.select(*keys, "_blk", item.alias("_t"), F.row_number().over(newest).alias("_r")).filter(F.col("_r") < n)
    tails = tails.groupBy(*keys, "_blk").agg(F.collect_list("_t").alias("_t"))
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(-max(n - 1, 1), -1)
    base = tails.select(*keys, "_blk", F.sort_array(F.flatten(F.collect_list("_t").over(across))).alias("_c"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(-(n - 1), 0)
    out = d.join(base, [*keys, "_blk"], "left").withColumn("_own", F.collect_list(item).over(inside))
    merged = F.concat(F.coalesce("_c", F.slice("_own", 1, 0)), F.col("_own"))
    last = F.slice(merged, F.greatest(F.size(merged) - n + 1, F.lit(1)), n)
    return out.withColumn(name, F.transform(last, lambda q: q["v"])).drop("_blk", "_c", "_own")


#: Sampled rows per bucket of a global rank, and buckets told apart in each of the two steps of the search.
_SAMPLED, _FAN = 20, 16


def with_global_rank(df: DataFrame, *order: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Add a 1-based rank over the whole table, without a one-task window and without a job while the plan is built.

    Rows go to buckets that follow each other in the order; the sizes of the earlier buckets plus the place inside the
    bucket are the rank. Bucket bounds come from a sample that a hash of the order columns chooses, about 20 rows per bucket; they
    decide how even the buckets are, not the ranks. End ``order`` with a unique column: it also splits runs of equal keys. The table is
    read for its count, its sample, its bucket sizes (order columns only) and its rows, which are shuffled once, so it must read the
    same each time.
    """
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keyed = df.withColumn("_key", key)
    slim = keyed.select("_key")
    share = slim.agg((F.lit(float(_SAMPLED * parts)) / F.greatest(F.count("*"), F.lit(1))).alias("s")).scalar()
    drawn = slim.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) < share * float(1 << 40))
    bounds = drawn.agg(F.array_sort(F.collect_list("_key")).alias("_all"))  # one row, some 20 keys per bucket
    bounds = bounds.select(F.filter("_all", lambda v, i: i % _SAMPLED == _SAMPLED - 1).alias("_bounds"))
    bounds = bounds.select("_bounds", F.filter("_bounds", lambda v, i: i % _FAN == _FAN - 1).alias("_coarse"))

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(bounds)).withColumn("_c", F.size(F.filter("_coarse", lambda v: v <= F.col("_key"))) * _FAN)
        near = F.filter(F.slice("_bounds", F.col("_c") + 1, _FAN), lambda v: v <= F.col("_key"))
        return found.withColumn("_bucket", F.col("_c") + F.size(near)).drop("_bounds", "_coarse", "_c")

    sizes = placed(slim).groupBy("_bucket").agg(F.count("*").alias("_n"))
    # one row per bucket: their number is bounded by ``parts``
    before = Window.orderBy("_bucket").rowsBetween(*_BEFORE)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    out = placed(keyed).withColumn("_place", place).join(F.broadcast(starts), "_bucket")
    return out.withColumn(name, F.col("_start") + F.col("_place")).select(*df.columns, name)


def stencil(df: DataFrame, keys: Sequence[str], position: str, count: str, block: int, value: str, weights: Sequence[float], name: str) -> DataFrame:
    """Add the weighted sum of the values around each row, mirrored at both ends of its key.

    ``position`` numbers the rows of a key from 0, ``count`` is their number. Rows go to blocks of ``block`` positions; those near a
    border also go to the block behind it, and those near an end of the key once more, under their mirrored positions. So a
    block holds all it needs, and of each block at most ``len(weights) - 1`` rows more than its own are shuffled. Rows
    whose neighbours are all NULL get NULL, other NULLs add nothing.
    """
    r = len(weights) // 2
    p, n = F.col(position), F.col(count)
    # all positions at which a row appears: p + 2nt and -1 - p + 2nt for whole t, within r of the key
    turns = F.sequence(-F.ceil((n + r) / (2 * n)), F.ceil((n + r) / (2 * n)))
    seen = F.flatten(F.transform(turns, lambda t: F.array(p + 2 * n * t, -1 - p + 2 * n * t)))
    near_end = (p < r) | (p >= n - r)
    places = F.when(near_end, F.filter(seen, lambda v: (v >= -r) & (v < n + r))).otherwise(F.array(p))
    rows = df.withColumn("_at", F.explode(places))
    lo, hi = F.greatest(F.col("_at") - r, F.lit(0)), F.least(F.col("_at") + r, n - 1)
    rows = rows.withColumn("_blk", F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))))
    own = (F.col("_at") == p) & (F.floor(p / block) == F.col("_blk"))
    w = Window.partitionBy(*keys, "_blk").orderBy("_at")
    around = {f"_n{k}": F.lag(value, r - k).over(w) for k in range(len(weights))}
    rows = rows.withColumn("_own", own).withColumns(around).filter("_own")
    total = sum((F.coalesce(F.col(c) * x, F.lit(0.0)) for c, x in zip(around, weights, strict=True)), F.lit(0.0))
    return rows.withColumn(name, F.when(F.coalesce(*around).isNotNull(), total)).select(*df.columns, name)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition by key for Python work. The explicit number keeps small but slow partitions from being merged."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def stream_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], start, step, schema: str) -> DataFrame:
    """Run a sequential fold over each key's ordered rows, holding one state at a time.

    Rows are partitioned by key and sorted on disk by Spark; Python reads them batch by batch, so a long key never has to
    fit in memory. ``start(key)`` makes the state of a key and ``step(state, chunk)`` turns the next rows of that key
    (a pandas frame) into output rows. A chunk is cut at batch ends: consecutive chunks may belong to one key.
    """
    keys, order = list(keys), list(order)

    def run(batches):
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            columns = [pdf[c].to_numpy() for c in keys]
            change = np.zeros(len(pdf) - 1, bool)
            for v in columns:
                change |= v[1:] != v[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)]
            found = []
            for a, b in zip(edges, edges[1:]):
                now = tuple(v[a] for v in columns)
                if now != key:
                    key, state = now, start(now)
                out = step(state, pdf.iloc[a:b])
                if out is not None and len(out):
                    found.append(out)
            if found:
                yield pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
