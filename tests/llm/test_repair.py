"""Conversation repair against brute force over all cheapest edit sequences."""

import hashlib
import random
import re
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from detlake.llm import repair
from detlake.llm.queries import QUERIES
from detlake.llm.repair import Lattice, repaired, report

from ..conftest import DATA


def brute(rows, found):
    """Cheapest edits by searching (cost, audit) in order; legality is asked of a regular expression, not of states."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        key = (i, roles[-1:], bool(roles))  # what can follow depends on the last role only
        if key in done:
            continue
        done.add(key)
        fits = lambda r: re.fullmatch("s?(ua)*u?", roles + r)
        if i < len(rows):
            heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                first = rows[i][0][:1]
                if first and fits(first):
                    heappush(heap, (cost + more, audit + "K", i + 1, roles + first))
                for r in "ua":
                    if fits(r):
                        heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r))
        for r in "ua":
            if fits(r):
                heappush(heap, (cost + 3, audit + "I", i, roles + r))
    raise AssertionError


def some(rng, n):
    roles = ["user", "assistant"] * 4 + ["system", "tool", " ", "", "u"]
    texts = ["Yes.", "No!", "what?", "cut", "", " \n", "a. ", "b"]
    return [(rng.choice(roles), rng.choice(texts) + (str(rng.randrange(9)) + "." if rng.random() < 0.6 else "")) for _ in range(n)]


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_edits_are_the_cheapest_and_the_least(stretch, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(1500):
        rows = some(rng, rng.randrange(14))
        found = repair.faults(rows)
        cost, audit = Lattice([r[:1] for r, _ in rows], found).cheapest()
        assert (cost, audit) == brute(rows, found), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in repaired(rows, audit)))


def test_prices_stay_below_the_true_costs():
    rng = random.Random(9)
    for _ in range(50):
        rows = some(rng, 8)
        found = repair.faults(rows)
        lattice = Lattice([r[:1] for r, _ in rows], found)
        known = lattice.auction(0, 9, [0, 0, 0, 0], range(4))
        assert known[0][0] == brute(rows, found)[0]
        assert all(known[s][0] >= lattice.auction(0, 9, [0, 0, 0, 0], (s,))[s][0] for s in range(4))


def test_one_very_long_conversation_takes_linear_work():
    rng = random.Random(2)
    rows = [(("user", "assistant")[i % 2] if rng.random() < 0.9 else "user", f"text {i}" + "." * (i % 9 > 0)) for i in range(20_000)]
    got = report(list(range(len(rows))), rows)
    assert got["illegal"] > 0 and len(got["turns"]) % 2 == 0
    calls = []
    arcs = Lattice.arcs
    Lattice.arcs = lambda self, i, s: calls.append(i) or arcs(self, i, s)
    try:
        Lattice([r[:1] for r, _ in rows], repair.faults(rows)).cheapest()
    finally:
        Lattice.arcs = arcs
    assert len(calls) < 6 * len(rows)


def test_faults_in_order():
    rows = [("user", "a"), ("user", "a"), ("user", "  "), ("user", "  "), ("assistant", "a"), ("user", "x! \n"), ("user", "x\x1f")]
    assert repair.faults(rows) == ["truncated", "duplicate", "blank", "blank", "truncated", None, "truncated"]


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "Hi.", "x"), (1, 1, "assistant", "Ho.", "x"), (2, None, "user", "Hi.", "x"), (2, None, None, None, "x"), (2, 7, "assistant", None, "x"),
        (None, 0, "user", "Hi.", "x"), (None, 1, "assistant", "Yes.", "x"), (3, 5, "assistant", "A.", "x"), (3, 5, "assistant", "A.", "x"), (3, 9, "system", "S.", "x"),
        (4, None, "", "", "x"), (5, 0, "user", "long " * 300_000 + ".", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").withColumn("audit", F.lit(1))
    got = {r.conv_id: r for r in repair.repair(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for c, r in got.items():
        own = sorted(((t, a if a is not None else " ", x if x is not None else " ") for i, t, a, x, _ in rows if i == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        want = report([x[0] for x in own], [x[1:] for x in own])
        assert r.asDict(recursive=True) == {"conv_id": c, **want}
    assert got[2].gaps == 0 and got[3].gaps == 3 and got[4].audit == "D" and got[5].audit == "KI"
    gone = df.where("conv_id IN (1, 2)").withColumn("gone", F.col("conv_id") == 1)
    lost = {r.conv_id: r for r in repair.repair(gone, gone_col="gone").collect()}
    assert (lost[1].audit, lost[1].cost, lost[1].turns) == ("", 0, []) and lost[2].audit == got[2].audit
    assert repair.repair(df.limit(0)).count() == 0


def test_query_keeps_every_conversation(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    out = QUERIES["op13_repair"](spark, DATA)
    assert {r.conv_id for r in out.collect()} == {r.conv_id for r in table.select("conv_id").distinct().collect()}
    damaged = repair.damage(table).collect()
    for r in out.collect():
        own = sorted((x.turn, x.role, x.text) for x in damaged if x.conv_id == r.conv_id and not x.gone)
        want = report([x[0] for x in own], [x[1:] for x in own])
        turns = [(t["role"], t["text"]) for t in want.pop("turns")]
        assert r.asDict() == {"conv_id": r.conv_id, **want, "repaired_sha256": digest(turns)}
