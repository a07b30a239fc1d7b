"""Every operator against a brute-force version on a small table with all awkward cases."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from detlake.llm import chat, components, decontaminate, html_templates, language_model, maxscore, near_duplicates, packing, repeats, token_files, toxicity
from detlake.llm.queries import remainder
from detlake.session import scratch_path


def key(rows):
    return sorted(rows, key=repr)


# 10 substring deduplication


def brute_repeats(rows, window):
    order = sorted(((NO if d is None else d), i, (t or "").encode().split()) for i, (d, t) in enumerate(rows))
    first = {}
    for d, _, w in order:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), d)
    out = []
    for d, _, w in order:
        own, off = set(), [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first[k] < d or k in own:
                off[s : s + window] = [True] * window
            own.add(k)
        out.append((None if d == NO else d, len(w), sum(off), b" ".join(x for x, o in zip(w, off, strict=True) if not o).decode()))
    return key(out)


NO = (1 << 63) - 1


def test_remove_repeats(documents):
    out = repeats.remove_repeats(documents).collect()
    assert [*out[0].asDict()][1:] == documents.columns
    got = key((r.doc_id, r.repeat.n_words, r.repeat.n_removed, " ".join((r.text or "").encode().decode().split())) for r in out)
    want = brute_repeats([(r.doc_id, r.text) for r in documents.collect()], 20)
    assert got == [(a, b, c, " ".join(d.split())) for a, b, c, d in want]
    assert all(sum(s.end - s.start for s in r.repeat.spans) == r.repeat.n_removed for r in out)
    assert sum(r.text is None for r in out) == documents.where("text IS NULL").count()


def test_remove_repeats_on_random_words(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(40)]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8, seed=3).collect()
    assert key((x.doc_id, x.repeat.n_words, x.repeat.n_removed, x.text) for x in out) == brute_repeats(rows, 8)


def test_remove_repeats_empty(empty):
    assert repeats.remove_repeats(empty).count() == 0


# 7 near duplicates


def brute_groups(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return key((d, len(x), None if d is None else find(d), d is None or find(d) == d) for d, x in sets)


def test_near_duplicates(documents):
    got = key(tuple(r) for r in near_duplicates.near_duplicates(documents).collect())
    assert got == brute_groups([(r.doc_id, r.text) for r in documents.collect()])


def test_near_duplicates_of_one_family(spark):
    """Edits of one text around the threshold: chains that no single representative links."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            w[r.randrange(150)] = f"e{i}_{r.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(tuple(x) for x in near_duplicates.near_duplicates(df).collect()) == brute_groups(rows)


def test_near_duplicates_empty(empty):
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    items = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in (1, 2, 7, 3000):
        assert (near_duplicates.sketch(items[:n]) != np.iinfo(np.uint64).max).all()
    a, b = near_duplicates.sketch(items[:2500], 2048), near_duplicates.sketch(items[500:], 2048)
    assert abs((a == b).mean() - 2000 / 3000) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (201, 200), (200, 201)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 decontamination


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance():
    r = random.Random(2)
    for _ in range(200):
        item, text = ("".join(r.choice("abc ") for _ in range(r.randint(1, 30))) for _ in range(2))
        assert decontaminate.Pattern(item).best(text)[0] == min(semi_global(item, text), len(item))


def test_find_leaks(spark, documents):
    r = random.Random(4)
    items = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 99)) for _ in range(20)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(items)] + [(50, None), (51, ""), (52, "?!"), (53, items[0]), (None, "null id"), (54, "naïve")]
    texts = []
    for i, t in enumerate(items):
        w = list(t)
        for _ in range(i * 2):
            w[r.randrange(len(w))] = r.choice("xyz")
        texts.append(f"Before, {''.join(w).upper()} -- after.")
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = documents.unionByName(extra, allowMissingColumns=True)
    found = decontaminate.find_leaks(docs, spark.createDataFrame(rows, "item_id long, text string"), block=4)
    assert found.columns == [*docs.columns, "leaks"] and found.count() == docs.count()
    got = key((x.doc_id, y.item_id, y.distance) for x in found.collect() for y in x.leaks)
    want = []
    for x in docs.collect():
        text = decontaminate.normalised(x.text or "")
        for i, t in rows:
            item = decontaminate.normalised(t or "")
            if i is not None and item and len(text) < 5000 and text:
                n = semi_global(item, text)
                if n <= len(item) // decontaminate.CHARS_PER_EDIT:
                    want.append((x.doc_id, i, n))
    assert got == key(want) and len(want) > 5
    none = decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("size(leaks) > 0").count() == 0 and none.count() == docs.count()


def test_find_leaks_sends_a_text_once(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon!"), (2, None), (3, ""), (4, "naïve")], "doc_id long, text string")
    as_string = decontaminate.find_leaks(docs, items)
    as_bytes = decontaminate.find_leaks(docs.withColumn("text", F.col("text").cast("binary")), items)
    replaced = decontaminate.find_leaks(docs, items, name="text")
    want = {1: [1], 2: [], 3: [], 4: []}
    for out, column in ((as_string, "leaks"), (as_bytes, "leaks"), (replaced, "text")):
        assert {r.doc_id: [x.item_id for x in r[column]] for r in out.collect()} == want
    assert {(r.doc_id, r.text) for r in as_string.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    plan = as_string._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "data#" not in plan


def test_find_leaks_of_an_item_that_repeats_a_phrase():
    item = " what is the sum of three and seven and what is the sum of five and nine if both of them are then doubled once more "
    for text in (item.replace("what is", "what was", 1).replace("five and", "five amd"), item.replace("and what is", "amd what was")):
        assert [x["distance"] for x in decontaminate.Finder([(1, item)], 20).find(f"x {text} y")] == [3]
    r = random.Random(8)
    for _ in range(150):
        phrase = "".join(r.choice("abc ") for _ in range(25))
        item = "".join(r.choice([phrase, phrase[:12], "".join(r.choice("abc ") for _ in range(9))]) for _ in range(5))
        text = [*item]
        for _ in range(r.randint(1, 5)):
            text[r.randrange(len(text))] = r.choice(["", "x", "ab"])
        text = phrase + "".join(text) + phrase
        got = {x["distance"] for x in decontaminate.Finder([(1, item)], 20).find(text)}
        best = semi_global(item, text)
        assert got == ({best} if best <= len(item) // 20 else set())


# 9 packing


def test_pack(documents, empty):
    measured = packing.measured(documents)
    out = packing.pack(measured, capacity=256, per_source=2, shard=10).collect()
    lengths = Counter()
    bins = {}
    for p in out:
        lengths[p.doc_id] += p.n_words
        assert (p.bin is None) == (p.n_words == 0) and p.start == 256 * p.piece
        if p.bin is not None:
            bins.setdefault(p.bin, []).append(p)
    want = Counter()
    info = {}
    for m in measured.collect():
        want[m.doc_id] += m.n_words
        info.setdefault(m.doc_id, []).append(m)
    assert lengths == want
    for rows in bins.values():
        assert sum(p.n_words for p in rows) <= 256
        single = [info[p.doc_id][0] for p in rows if len(info[p.doc_id]) == 1]
        assert len({m.cluster for m in single}) == len(single)
        assert max(Counter(m.source for m in single).values(), default=0) <= 2
    assert packing.pack(packing.measured(empty)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rows = [((0,), 6, "a", 1), ((1,), 5, "a", 2), ((2,), 4, "b", 1), ((3,), 4, "b", 3), ((4,), 5, "c", 9)]
    where = {i: b for i, _, _, b in packing.pack_shard(rows, 10, 1)}
    assert where[4] == where[1]  # fills the bin of row 1 up
    assert where[3] == where[0]  # row 2 fits there too, but is a duplicate of row 0
    assert where[2] not in (where[0], where[1])


# 8 exact top-k


@pytest.mark.parametrize("shard", [7, 1000])
def test_top_k(spark, shard):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(300, [0.0] * 6), (301, [-5.0] * 6), (302, [1.0, 2.0]), (303, [])]
    rows += [(400, None), (401, [None] * 6), (402, [math.nan] * 6), (403, [math.inf] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, shard string")
    got = maxscore.top_k(df, F.col("vec_id") % 20 == 0, k=4, shard=shard, block=3).collect()
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, a in good.items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good.items() if i != q)[:4]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert key(map(tuple, got)) == key(want)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [3e38, 0.0]), (3, [-3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in maxscore.top_k(df, F.col("vec_id") == 0).collect()}
    assert got[1] == (10**6 * 256) ** 2 + 256 * 512 and got[2] == (1 << 63) - 1 and got[3] == -(1 << 63)


# 6 token files


def test_token_files(spark, documents, empty):
    path, tokenizer = scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    odd = ["ÀÉ İstanbul ΣΑΣ. ß ẞ été don't it's x<|endoftext|>y <|startoftext|> 12.5, ... ?! 日本語 ª ŉ Ǆ", "'s 's. a's", "\x1c\x85a"]
    docs = documents.unionByName(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    token_files.write_tokens(docs, path, tokenizer, shard_bytes=200, parts=4)
    rows = token_files.read_tokens(spark, path).collect()
    plain = Tokenizer.from_file(tokenizer)
    want, at = [], 0
    order = sorted(docs.collect(), key=lambda r: (NO if r.doc_id is None else r.doc_id, (r.text or "").encode()))
    for r in order:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in sorted(rows, key=lambda r: r.start)] == want
    assert spark.read.parquet(f"{path}/shards").count() > 4
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(empty, path, tokenizer)
    assert token_files.read_tokens(spark, path).count() == 0


def test_short_document_access_and_wrong_dictionary():
    import zstandard

    frames = [zstandard.ZstdCompressor().compress(np.arange(n, dtype="<u2").tobytes()) for n in (3, 0, 5)]
    data = token_files.write_shard([(1, 0, 3), (2, 3, 0), (9, 3, 5)], frames, hashlib.sha256(b"").digest())
    assert token_files.ShardReader(data, b"").ids(2).tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        token_files.ShardReader(data, b"other")


# 2 chat


def test_escape_is_reversible(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("<|\\>es") for _ in range(r.randint(0, 12))) for _ in range(500)] + [chat.START, chat.END, chat.SEP, "<\\|", "\\"]
    df = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, seq long, role string, text string")
    out = chat.read_back(chat.render(chat.fold(df))).collect()
    assert {x.conv_id: x.turns[0].text for x in out} == dict(enumerate(texts))
    assert all("".join(x.learned) == texts[x.conv_id] for x in out)


def test_fold_and_render(spark, empty):
    log = [
        (1, 0, "message", "a", "user", "Hi"), (1, 1, "delta", "b", "assistant", "He"), (1, 3, "delta", "b", None, "lo"), (1, 2, "delta", "b", None, "l"),
        (1, 4, "message", "c", "user", "again"), (1, 5, "message", "d", "assistant", "old"), (1, 6, "regenerate", "b", None, "N"),
        (1, 7, "delta", "b", None, "ew"), (1, 8, "edit", "a", None, "Hello"), (1, 9, "message", None, "user", None), (1, 9, None, None, None, "x"),
        (None, 0, "message", None, "assistant", "no id"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(df))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "Hello"), ("assistant", "New"), ("", "x"), ("user", "")]
    assert out[1].learned == ["New"] and out[None].learned == ["no id"]
    at = out[1].formatted.index("New")
    turn = out[1].formatted.index("<|start|>assistant")
    assert [tuple(x) for x in out[1].loss] == [(0, 0), (at - turn, 3), (0, 0), (0, 0)]
    assert chat.render(chat.fold(df.limit(0))).count() == 0


# 5 toxicity


def toxic_table(spark):
    r = random.Random(9)
    words = [f"{a}{b}" for a in "kolmir" for b in ("ta", "ne", "su", "po")]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(40), r.choice(["zorgling", "zorgish", "blarg"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic) if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, documents, empty):
    docs, labels = toxic_table(spark)
    grammar = toxicity.fit(docs, labels, remainder(3) != 1)
    out = {r.doc_id: r.toxicity for r in toxicity.score(docs, grammar).collect()}
    assert all((out[i] >= 0.7) == (i % 5 == 0) for i in range(600))
    awkward = toxicity.score(documents, grammar)
    assert awkward.columns == [*documents.columns, "toxicity"] and awkward.count() == documents.count()
    assert awkward.where("toxicity < 0 OR toxicity > 1 OR toxicity IS NULL").count() == 0
    assert toxicity.score(empty, grammar).count() == 0
    blind = toxicity.fit(docs, labels.limit(0), remainder(3) != 1)
    assert blind.insults == dict.fromkeys(toxicity.INSULTS, toxicity.PRIOR) and len({r.toxicity for r in toxicity.score(docs, blind).collect()}) == 1


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"blarg": 4.0, "zorg~": 4.0}, 1.0, -1.0)
    plain, aimed = g.weight("what a blarg thing"), g.weight("you are a blarg")
    assert aimed > plain > g.weight("not a blarg thing") > 0
    assert plain > g.weight("he said blarg") > g.weight("he said not blarg")
    assert g.weight("zorging") == 4.0 and g.weight("zorg") == 0 and g.weight("they kill") > g.weight("kill") == 0
    assert g.weight("not. a blarg") == plain  # a clause ends a negation


def test_threats_before_their_target():
    g = toxicity.Grammar({}, 1.0, -1.0)
    for text in ("I will kill you", "we will destroy them", "burn your house"):
        assert g.weight(text) == 1.0 > g.weight("they burn wood"), text
    assert 1 > g.weight("he said I will kill you") > g.weight("I will not kill you") > g.weight("he said I will not kill you") > 0
    assert g.weight("kill time") == g.weight("kill. you") == 0


def test_copies_do_not_make_insults(spark):
    docs, labels = toxic_table(spark)
    copy = "quirk snark " + " ".join(f"c{i}" for i in range(20))
    more = spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit(copy).alias("text"))
    marks = spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    grammar = toxicity.fit(docs.union(more), labels.union(marks), remainder(3) != 1)
    assert not {"quirk", "snark"} & set(grammar.insults) and "blarg" in grammar.insults


# 4 html


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="page{n}"><article><h1>Title  {n}</h1><p>First&nbsp;para &lt;b&gt; <b>bold</b><br>next<p>Second {n} &eacute;
<div class="share">Share</div><blockquote>Quote</blockquote><ul><li>One</li><li>Two</li></ul>
<form><input name=a>Sign up</form><section class="comments"><p>Reader {n} says</p></section></article></div>
<aside>Side</aside><!-- ad --><div class="ad">Buy</div><footer>&copy; 2020</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(n=i)) for i in range(6)]
    rows += [(10, "http://h0.org/e", None), (11, None, ""), (12, "::bad[", "plain  text"), (0, rows[0][1], rows[0][2])]
    rows += [(None, "http://solo.net/", "<div><p>Alone"), (13, "http://solo2.net", "<main><p>x</p>" + "<p>y z</p>" * 5000 + "</main><!-- open")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, slot string")
    out = html_templates.extract(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    for i in range(6):
        assert got[i] == f"Title {i}\nFirst para <b> bold next\nSecond {i} é\nQuote\nOne\nTwo"
    assert got[10] == got[11] == "" and got[12] == "plain text" and got[None] == "Alone"
    assert got[13] == "x\n" + "\n".join(["y z"] * 5000)
    assert html_templates.extract(df.limit(0)).count() == 0


def test_html_without_article_element(spark):
    page = '<body><div class="top"><a href="/">Home</a></div><div class="content{n}"><p>{a}</p><p>{b}</p></div><div class="related">More</div></body>'
    rows = [(i, f"http://h.org/{i}", page.format(n=i, a=f"long text {i} " * 9, b=f"more {i}")) for i in range(5)]
    out = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: (f"long text {i} " * 9).strip() + f"\nmore {i}" for i in range(5)}


def test_html_marks_are_attributes_of_their_own_name():
    kept = ['style="overflow:hidden"', 'aria-hidden="false"', "data-hidden=1", 'title="the hidden coast"', "data-class='ad'", "data-id=share", 'alt="class=ad"']
    for attribute in kept:
        for tag in ("div", "article", "main", "body", "p"):
            assert html_templates.blocks(f"<{tag} {attribute}>Text</{tag}>")[0], (tag, attribute)
    for attribute in ("hidden", 'hidden=""', 'aria-hidden="true"', 'class="x ad"', "id=share", 'role="navigation"'):
        assert not html_templates.blocks(f"<div {attribute}>Text</div>")[0], attribute
    page = '<h2 id="related-work">Related</h2><p id="share-prices">Prices</p><h3 id=comments-on-x>On x</h3><p class="notice">Off'
    assert [t for _, t in html_templates.blocks(page)[0]] == ["Related", "Prices", "On x"]


def test_html_unclosed_paragraphs_and_items_end():
    def texts(page):
        return [t for _, t in html_templates.blocks(page)[0]]

    assert texts('<div><p class="notice">Off<p>One<p>Two</div>') == ["One", "Two"]
    assert texts('<p class="notice">Off <b class="ad">off<h2>Title</h2>Text') == ["Title", "Text"]
    assert texts('<blockquote><p class="notice">Off</blockquote>Text') == ["Text"]
    assert texts('<ul><li class="share">Off<p>off<ul><li>off</ul>off<li>One</ul>Text') == ["One", "Text"]
    assert texts('<ul><li>One<li class="share">Off</ul><p>Text</p>') == ["One", "Text"]
    assert texts('<div class="ad"><p>off<div>off</div>off</div>Text') == ["Text"]


# 3 language model


def test_language_model(spark, documents, empty):
    docs = documents.unionByName(
        spark.createDataFrame([(3000 + i, " ".join(random.Random(i).choice("red blue green".split()) for _ in range(50))) for i in range(40)], "doc_id long, text string"),
        allowMissingColumns=True,
    )
    out = language_model.score(docs, remainder(10) != 0).collect()
    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), b"\n"]) for r in docs.collect()]
    held = {d: d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in tokens}
    c = Counter(w for d, t in tokens if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    want = key((d, held[d], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, t in tokens)
    assert key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert language_model.score(empty, remainder(10) != 0).count() == 0
    none = language_model.score(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)


def test_every_training_text_reaches_the_weights(spark):
    rows = [(i, f"only{i} " * 5) for i in range(120)]
    texts = spark.createDataFrame(rows, "key long, text string").select("key", F.col("text").cast("binary").alias("data"))
    v = language_model.vocabulary(language_model.count_words(texts))
    before, after = language_model.initial(v)["wx"], language_model.fit(texts, v)["wx"]
    assert len(v.words) == 121 and (before[:121] != after[:121]).any(axis=1).all()


def small_vocabulary():
    words = [b"\n", *(f"w{i}".encode() for i in range(30))]
    types = np.zeros(language_model.OTHERS)
    return language_model.Vocabulary(words, np.arange(60, 29, -1.0), 1000, 31, types.copy(), types)


def test_probabilities_add_up():
    v = small_vocabulary()
    p = language_model.initial(v)
    symbols = np.arange(language_model.SYMBOLS)
    total = sum(10 ** language_model.log10_likelihoods(p, [np.array([s], np.int32)], 0)[0] for s in symbols)
    assert abs(total - 1) < 1e-4


def test_gradients_and_carried_state():
    v = small_vocabulary()
    p = {k: x.astype(np.float64) for k, x in language_model.initial(v).items()}
    text = np.array([1, 5, 3, 2048, 7, 0], np.int32)
    p32 = {k: x.astype(np.float32) for k, x in p.items()}
    long = np.tile(text, 30)
    whole = language_model.log10_likelihoods(p32, [long, text], 0)
    state, total = np.zeros((1, language_model.HIDDEN), np.float32), 0.0
    for s, t in zip([0, *long[:-1]], long, strict=True):  # one step at a time
        h = language_model.forward(p32, np.array([[s]]), state)
        total += language_model.outputs(p32, h[0], np.array([t]))[0][0]
        state = h[-1]
    assert abs(whole[0] - total / math.log(10)) < 1e-2
    before = language_model.log10_likelihoods(p32, [text], 0)[0]
    for _ in range(30):
        language_model.train(p32, [text] * 4, 0)
    assert language_model.log10_likelihoods(p32, [text], 0)[0] > before + 1


def test_model_beats_unigrams_on_held_out_texts(spark):
    """Two languages: a model that carries its state knows which one it reads."""
    r = random.Random(0)
    langs = [[f"{a}{i}" for i in range(40)] for a in ("x", "y")]
    rows = [(i, " ".join(r.choice(langs[i % 2]) for _ in range(100))) for i in range(3000)]
    out = language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), remainder(10) != 0).where("held_out").collect()
    assert sum(x.score for x in out) > sum(x.base_score for x in out) * 0.9


# labels and tables of the driver


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the given tables")
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            counts.append(docs.count())
    toxic = pd.read_parquet(f"{folder}/labels.parquet").toxic.sum()
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0] and counts[0] - counts[1] >= toxic
    assert docs.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n_words").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0


def test_pipeline_handles_awkward_rows(spark, documents, empty):
    import corpus_pipeline

    for docs in (documents, empty):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, name)
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
            if name != "packing":
                assert spark.read.parquet(path).columns == documents.columns
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (n > 0)
