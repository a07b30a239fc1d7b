import pytest
from pyspark.sql import functions as F

AWKWARD = [None, "", "   ", "\n\t", "one", "ONE two", "naïve Ünïcode words, here."]


@pytest.fixture(scope="session")
def documents(spark):
    """Small table with nulls, empty and long texts, repeated rows and ids, copies, near copies and clashing columns."""
    base = " ".join(f"w{i}" for i in range(200))
    near = " ".join(f"w{i}" if i % 60 else f"x{i}" for i in range(200))
    inner = " ".join(f"p{i}" for i in range(40))
    texts = [*AWKWARD, base, base, near, base.upper(), f"a b c {inner} d e f", f"g h {inner} i", inner, " ".join(["again and again"] * 30)]
    texts += [" ".join(f"t{j}_{i}" for i in range(30)) for j in range(5)] + [" ".join(f"long{i % 997}" for i in range(30_000))]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, None if t is None else len(t), "x") for i, t in enumerate(texts)]
    rows += [rows[7], rows[9], (None, base, None, None, None, "y"), (None, None, None, None, None, None), (8, "another text of id eight", "en", "src0", 24, "z")]
    # names that operators use inside
    schema = "doc_id long, text string, lang string, source string, n_chars long, d string"
    df = spark.createDataFrame(rows, schema).withColumn("n_words", F.lit(-1)).withColumn("rest", F.lit("r")).withColumn("data", F.lit(0))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
