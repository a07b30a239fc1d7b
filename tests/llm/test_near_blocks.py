"""Second round of the near-duplicate search: rows it passes on, and buckets in several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from detlake.llm import near_duplicates as N
from detlake.llm import repeats

from .test_operators import brute_groups, key


def family(n, seed=5):
    r = random.Random(seed)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(150)] = f"e{i}_{r.random()}"
        rows.append((i, " ".join(w)))
    return rows


def test_buckets_in_many_blocks(spark):
    rows = family(90) + [(1000 + i, t) for i, t in family(40, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(tuple(x) for x in N.near_duplicates(df, block=800).collect()) == brute_groups(rows)


@pytest.fixture
def passed(monkeypatch):
    found = []
    between = N._links_between

    def count(*args):
        out = N.materialize(between(*args), "counted")
        found.append(out.count())
        return out

    monkeypatch.setattr(N, "_links_between", count)
    return found


def test_rows_of_the_second_round_grow_with_the_members(spark, passed):
    for n in (200, 400, 800):
        df = spark.createDataFrame(family(n), "doc_id long, text string")
        components = N.near_duplicates(df).agg(F.countDistinct("component_id")).first()[0]
        assert components < n
    assert all(p < n for p, n in zip(passed, (200, 400, 800), strict=True)), passed


def test_texts_whose_short_hashes_collide(spark):
    """Rows without id whose texts have one 32-bit hash: only the one with a passage of document 1 loses it."""
    passage = " ".join(f"p{i}" for i in range(25))
    some = spark.range(300_000).select(F.concat(F.lit(passage), F.lit(" q"), F.col("id").cast("string"), F.lit(" r s t u v")).alias("a"))
    other = spark.range(300_000).select(F.concat_ws(" ", *[F.concat(F.lit(f"x{i}_"), F.col("id").cast("string")) for i in range(31)]).alias("b"))
    pair = some.join(other, F.hash("a") == F.hash("b")).orderBy("a").first()
    assert pair
    rows = [(1, f"{passage} end"), (None, pair.a), (None, pair.b), (None, pair.a), (5, "few words")]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.repeat.n_removed, r.text) for r in out.collect())
    rest = " ".join(pair.a.split()[25:])
    assert got == sorted([(1, 0, rows[0][1]), (0, 25, rest), (0, 25, rest), (0, 0, pair.b), (5, 0, "few words")])
