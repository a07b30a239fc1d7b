"""Token files of rows that share an id: spread over parts, read back whole."""

import numpy as np
from pyspark.sql import functions as F
import public_tokenizers
from tokenizers import Tokenizer

from detlake.llm import token_files


def test_one_id_for_most_rows_is_spread_and_whole(spark, tmp_path):
    rows = [(None, "the same words again")] * 3000 + [(None, f"text number {i}") for i in range(3000)] + [(7, f"seven {i % 50}") for i in range(2000)] + [(9, None), (2, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    name, path = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t")
    token_files.write_tokens(docs, path, name, parts=8, shard_bytes=4096)
    per_part = [r.n for r in spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert len(per_part) == 8 and max(per_part) < sum(per_part) / 3
    own = Tokenizer.from_file(name)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    at, ids, seen = 0, [], []
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
        ids.append(r.doc_id)
        seen.append((r.doc_id is None, r.doc_id or 0, bytes(r.ids)))
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
    known = {t: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in {t for _, t in rows}}
    assert sorted(seen) == sorted((d is None, d or 0, known[t]) for d, t in rows)
