"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from detlake.llm import spelling
from detlake.llm.queries import QUERIES

from ..conftest import DATA

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def neighbours(words):
    """Near words by deletion neighbourhoods: words are one edit apart if they share a word with one letter left out at fitting places."""
    known, near = set(words), {w: set() for w in words}
    letters = sorted({c for w in words for c in w})
    for w in words:
        for i in range(len(w) + 1):
            for c in letters:
                for x in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :] if i < len(w) else w):
                    if x != w and x in known:
                        near[w].add(x)
                        near[x].add(w)
    return near


def brute(words, times=10):
    near, form = neighbours(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        end = w
        while form[end]:
            end = form[end]
        out.append((w, form[w], end, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def brute_words(rows, slip=31):
    counts = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def found(spark, words, **kw):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(df, **kw).select(COLUMNS).collect())


def family(rng, size, letters="abé", low=7, high=11):
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        words[w] = rng.choice([2, 3, 5, 20, 50, 400, 9000])
        i = rng.randrange(len(w))
        for x in (w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w + w[-1], w[0] + w):
            if len(x) >= low and rng.random() < 0.5:
                words[x] = rng.choice([2, 3, 30, 700])
    return words


def test_dense_family_equals_brute_force(spark):
    words = family(random.Random(3), 900)
    assert found(spark, words) == brute(words)


def test_divided_groups_and_small_indexes_change_nothing(spark, monkeypatch):
    words = family(random.Random(4), 600, "ab", 7, 9)
    want = brute(words)
    assert found(spark, words, letters=40) == want
    monkeypatch.setattr(spelling, "LETTERS", 64)
    monkeypatch.setattr(spelling, "POSITIONS", 2)
    monkeypatch.setattr(spelling, "ITEMS", 16)
    assert found(spark, words, letters=300) == want


def test_groups_stay_small_however_many_words_share_a_half(spark):
    words = {f"same{a}{b}{c}{d}": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcdefgh"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    groups = spelling.grouped(df, letters=800).groupBy("m", "s", "e", "pre", "suf").count().agg({"count": "max"}).first()[0]
    assert groups <= 100
    assert {r[4] for r in found(spark, words, letters=800)} == {28}


def test_long_words_ties_chains_and_empty_tables(spark):
    long = "".join(random.Random(5).choice("abcdefghij") for _ in range(3000))
    words = {long: 500, long[:1500] + long[1501:]: 3, long[:700] + "ü" + long[701:]: 2, "aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 20, "aaaaaac": 20, "aaaaabc": 300}
    words |= {"chained": 2, "chainedx": 20, "chainedxy": 200, "chainedxyz": 2000, "chainedxyzz": 20000, "lonelyword": 9}
    got = found(spark, words)
    assert got == brute(words)
    assert {r[2] for r in got if r[0].startswith("chained")} == {"chainedxyzz"}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_awkward_documents(spark, documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(i, "The Quickest BROWNISH Élèvesx×y÷z Straßenbahn straßenbahn quickest brownish quickes") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in spelling.spelling_variants(df, slip=31).select(COLUMNS).collect())
    assert got and got == brute(brute_words(rows))
    assert spelling.spelling_variants(empty, slip=31).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_spelling"](spark, DATA).select(COLUMNS).collect())
    assert got == brute(brute_words(rows))
