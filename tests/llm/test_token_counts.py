"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from detlake.llm.queries import QUERIES
from detlake.llm.token_counts import TokenCounter, count_tokens

from ..conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "  a", "a  b\n\n c", "x \n", "don't WE'LL 's't", "a  b", "\x1c a\x1db \x85  x　y", "x<|endoftext|>y  <|endoftext|> z",
        "<|endoftext|><|endoftext|>", "a" * 5000, " " * 3000 + "x", "é" * 100 + "🙂👩‍👩", "\t\r\n \x0b", "日本語 テスト՘x",
        "".join(map(chr, range(1, 0x3000))), " ".join(map(chr, range(0x3000, 0xD800, 7))), "ab" * 300_000,
    ],
)
def test_counts_equal_the_library(text):
    assert TokenCounter(PATH).count(text) == library(text)


def test_random_texts_and_a_small_memory(monkeypatch):
    monkeypatch.setattr("detlake.llm.token_counts.REMEMBERED", 5)
    monkeypatch.setattr("detlake.llm.token_counts.TOGETHER", 7)
    own, rng = TokenCounter(PATH), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "'s", "9", "<|endoftext|>", "…", "ß", " ", "ing"]) for _ in range(rng.randrange(60)))
        assert own.count(text) == library(text)


def test_merges_follow_the_ranks_not_the_places():
    own = TokenCounter(PATH)
    for word in (b" unbelievable", b"aaaaaaa", b"\xff\xfe\xfd", b"x"):
        symbols = [own.symbol[b] for b in word]
        while True:  # merge the lowest rank, leftmost first, on a plain list
            ranked = [(own.rank.get(p), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in own.rank]
            if not ranked:
                break
            r, i = min(ranked)
            symbols[i : i + 2] = [own.merged[r]]
        assert own.merge(word) == len(symbols)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_every_row_of_an_awkward_table(spark, documents, empty):
    got = count_tokens(documents, PATH, limit=5)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r.doc_id, len((r.text or "").encode()), library(r.text), library(r.text) > 5) for r in documents.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert count_tokens(empty, PATH).count() == 0


def test_query_over_the_whole_table(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op11_token_counts"](spark, DATA).collect()
    assert len(rows) == len(texts)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n := library(texts[r.doc_id]), n > 512) for r in rows)
