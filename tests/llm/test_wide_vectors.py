"""Inner products of many large components."""

import random

from pyspark.sql import functions as F

from detlake.llm import maxscore


def test_sums_of_many_large_products_are_exact(spark):
    rnd = random.Random(3)
    big = 4_000_000
    rows = [(i, [float(rnd.choice([big, big - 1, big + 1, 1])) for _ in range(1500)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id): r.score for r in maxscore.top_k(df, F.col("vec_id") == 0, k=7, scale=1).collect()}
    assert got == {i: sum(int(a) * int(b) for a, b in zip(rows[0][1], v, strict=True)) for i, v in rows if i}
