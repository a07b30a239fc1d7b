"""Best-fit packing against a plain search over all bins, and the grammar of threats against rules written out."""

import random
from collections import Counter

import pytest

from detlake.llm import packing, toxicity


def _plain(rows, capacity, per_source):
    """Every piece looks at every bin: the tightest that holds neither its cluster nor enough of its source, the oldest of equals."""
    pieces = sorted(((min(capacity, r[1] - a), i, a) for i, r in enumerate(rows) for a in range(0, r[1], capacity)), key=lambda p: (-p[0], rows[p[1]][0], p[2]))
    bins, out = [], {}
    for length, i, start in pieces:
        _, _, source, cluster = rows[i]
        fits = [
            (b["left"], k) for k, b in enumerate(bins)
            if b["left"] >= length and cluster not in b["clusters"] and b["sources"][source] < per_source
        ]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
            k = len(bins) - 1
        bins[k]["left"] -= length
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"][source] += 1
        out[i, start] = (length, k)
    return out


def _rows(seed):
    r = random.Random(seed)
    n, capacity = r.randint(0, 150), r.choice([1, 7, 50])
    rows = [((False, i, 0), r.randint(0, capacity * 2 if r.random() < 0.1 else capacity), r.choice("aaab") if r.random() < 0.9 else None, r.randint(0, 40)) for i in range(n)]
    return rows, capacity, r.randint(1, 4)


@pytest.mark.parametrize("seed", range(60))
def test_bins_equal_a_search_over_all(seed):
    rows, capacity, per_source = _rows(seed)
    got = packing.pack_shard(rows, capacity, per_source)
    assert {(i, a): (length, b) for i, a, length, b in got if b is not None} == _plain(rows, capacity, per_source)
    assert sorted(i for i, *_, b in got if b is None) == [i for i, r in enumerate(rows) if not r[1]]


def test_one_shard_on_spark_equals_the_search(spark):
    rows, capacity, per_source = _rows(8)
    frame = spark.createDataFrame([(k[1], s, w, c) for k, w, s, c in rows], "doc_id long, source string, n_words long, cluster long")
    got = {(r.doc_id, r.start): (r.n_words, r.bin) for r in packing.pack(frame.repartition(5), capacity, per_source, 10_000).collect() if r.bin is not None}
    assert got == _plain(rows, capacity, per_source)


def _by_rules(tokens, grammar):
    """The weight of a clause from its words before each place, without states."""
    total = 0.0
    kinds = [toxicity.INSULT if grammar.insult(t) else toxicity._CLOSED.get(t, toxicity.OTHER) for t in tokens]
    for i, kind in enumerate(kinds):
        before = [k for k in kinds[:i] if k in (toxicity.NEGATION, toxicity.REPORT)]
        negated = bool(before) and before[0] == toxicity.NEGATION or toxicity.NEGATION in before
        governed = 0.4 if negated and toxicity.REPORT in before else 0.6 if negated else 0.7 if before else 1.0
        # threats and targets alternate: only a change of kind moves the match on
        steps = [k for k in kinds[:i] if k in (toxicity.THREAT, toxicity.TARGET)]
        steps = [k for j, k in enumerate(steps) if not j or steps[j - 1] != k]
        last, begun = (steps[-1] if steps else None), steps[:1] == [toxicity.TARGET] or len(steps) > 1
        if kind == toxicity.INSULT:
            total += grammar.insult(tokens[i]) * governed * (1.5 if begun and governed == 1.0 else 1.0)
        elif kind == toxicity.TARGET and last == toxicity.THREAT:
            total += governed * (1.0 if steps == [toxicity.THREAT] else 0.5)
        elif kind == toxicity.THREAT and last == toxicity.TARGET:
            total += governed * 0.5
    return total


@pytest.mark.parametrize("seed", range(40))
def test_transducer_equals_the_rules(seed):
    r, grammar = random.Random(seed), toxicity.Grammar({"idiot": 4.0, "scum": 3.0})
    for _ in range(100):
        tokens = [r.choice("you they kill burn idiot scum not said tree walks".split()) for _ in range(r.randint(0, 8))]
        assert grammar.clause(tokens) == pytest.approx(_by_rules(tokens, grammar)), tokens
