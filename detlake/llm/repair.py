"""Repair of conversation structure: cheapest edits by the auction algorithm for shortest paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of the edits; a truncated row that stays costs more.
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a stretch that is searched at a time; work grows with rows times this.
STRETCH = 64
#: Fixed value: white space of blank texts.
SPACE = " \t\n\x0b\x0c\r"

# States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. A new or retyped row has one legal role in each.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
_KEEP = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_LEGAL = {"su", "ua", "au"}

BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
SCHEMA = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "turns array<struct<role: string, text: string>>"
)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults made on purpose, by crc32 of ``<conv>:<turn>`` modulo 20 (nulls are one space): 0 drops a row, 1 empties its text, 2 removes
    ``.!?``, 3 repeats it, 4 makes its role user. A dropped row stays with ``gone`` set, so that its conversation is known."""
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in (conv_col, turn_col)))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(text_col, space)
    damaged = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(
        F.col(conv_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(F.coalesce(role_col, space)).alias(role_col),
        damaged.alias(text_col), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text): blank, duplicate of an earlier row, truncated; or None."""
    seen, out = set(), []
    for row in rows:
        text = row[1].strip(SPACE)
        if not text:
            out.append(BLANK)
        elif row in seen:
            out.append(DUPLICATE)
        else:
            out.append(None if text[-1] in ".!?" else CUT)
        seen.add(row)
    return out


class Lattice:
    """Nodes (place, state): so many rows are behind, and the roles kept so far are in this state. Arcs are edits."""

    def __init__(self, initials: list[str], found: list[str | None]):
        self.initials, self.found, self.n = initials, found, len(initials)

    def arcs(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, place, state) of the edits at a node, in order of their initials; the empty initial ends the conversation."""
        out = []
        if i == self.n:
            if state in (_START, _ASSISTANT):
                out.append(("", 0, i + 1, _START))
        else:
            out.append(("D", DELETE, i + 1, state))
        out.append(("I", INSERT, i, _NEXT[state]))
        if i < self.n and self.found[i] not in (BLANK, DUPLICATE):
            more = TRUNCATED if self.found[i] == CUT else 0
            kept = _KEEP[state].get(self.initials[i])
            if kept is not None:
                out.append(("K", more, i + 1, kept))
            out.append(("R", RETYPE + more, i + 1, _NEXT[state]))
        return out

    def least(self, i: int) -> int:
        """What row ``i`` costs at least."""
        return 0 if i >= self.n or not self.found[i] else TRUNCATED if self.found[i] == CUT else DELETE

    def auction(self, a: int, b: int, beyond: list[int], states: range | tuple[int, ...]) -> dict[int, tuple[int, str, int]]:
        """Cost to the end, edits up to place ``b`` and the state there, from place ``a`` in each of ``states``.

        ``beyond`` are the costs from place ``b`` on. Every node has a price, a lower bound of its cost to the end. A path grows from its
        start: if the last node's price is below what its best arc offers, the price rises to that and the path contracts by this node,
        else the path extends along the best arc. When the path reaches ``b``, all its arcs are tight, so the start's price is
        its cost. Of equal arcs the first initial is taken; arcs with smaller initials then cost more, and prices only rise, so the
        edits are the least ones in ASCII order among the cheapest.
        """
        floor, price, arcs = min(beyond), {}, {}
        for i in range(b - 1, a - 1, -1):
            floor += self.least(i)
            for s in range(4):
                price[i, s] = floor
        price.update(((b, s), c) for s, c in enumerate(beyond))
        out = {}
        for start in states:
            path, labels = [(a, start)], []
            while path[-1][0] < b:
                node = path[-1]
                if node not in arcs:
                    arcs[node] = self.arcs(*node)
                best, step, to = None, "", None
                for label, cost, i, s in arcs[node]:
                    offer = cost + price[i, s]
                    if best is None or offer < best:
                        best, step, to = offer, label, (i, s)
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                        labels.pop()
                else:
                    path.append(to)
                    labels.append(step)
            out[start] = price[a, start], "".join(labels), path[-1][1]
        return out

    def cheapest(self) -> tuple[int, str]:
        """Least cost and edits of the whole conversation, searched in stretches from its end, then joined from its start."""
        ends = [*range(0, self.n + 1, STRETCH), self.n + 1]
        beyond, solved = [0, 0, 0, 0], []
        for a, b in reversed(list(zip(ends, ends[1:], strict=False))):
            known = self.auction(a, b, beyond, (_START,) if a == 0 else range(4))
            beyond = [known[s][0] if s in known else 0 for s in range(4)]
            solved.append(known)
        state, audit = _START, []
        for known in reversed(solved):
            _, labels, state = known[state]
            audit.append(labels)
        return beyond[_START], "".join(audit)


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits; new rows have empty texts."""
    out, left, state = [], iter(rows), _START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = _ROLE[state]
        state = _KEEP[state][role[0]]
        out.append((role, text))
    return out


def report(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    """All that is known of one conversation, its repaired rows included."""
    found, initials = faults(rows), [role[:1] for role, _ in rows]
    cost, audit = Lattice(initials, found).cheapest()
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(CUT),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in repaired(rows, audit)],
    }


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """Per conversation: faults, the cheapest edits that give it a legal structure, and its repaired ``turns``.

    Legal are an optional system row first, then pairs of user and assistant, or nothing. Rows are taken by turn (nulls first), equal turns by
    role and text. Keeping a row is free, another role costs 3, deleting 4 (blank and duplicate rows must go), a new empty row 3, a
    truncated row that stays 3. ``audit`` has the edits' initials (D, I, K, R).

    Null roles and texts are one space; conversations without id are one; repeated rows are duplicates; rows marked by ``gone_col`` only
    name their conversation; an empty table gives an empty result; other columns are ignored. Rows are dealt by conversation and
    sorted by Spark; a task holds one conversation, whose repaired rows are one value of the result.
    """
    kind, space = rows.schema[conv_col].dataType.simpleString(), F.lit(" ")
    gone = F.coalesce(gone_col, F.lit(False)) if gone_col else F.lit(False)
    base = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"),
        F.coalesce(text_col, space).alias("text"), gone.alias("gone"),
    )
    ranged = base.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    to_arrow = pa.schema(
        [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
         ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, held, started = None, [], [], False
        ids, done, size = [], [], 0

        def out(of: pa.DataType) -> pa.RecordBatch:
            reports = pa.RecordBatch.from_pylist(done, to_arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(ids, of), *reports.columns], ["conv", *reports.schema.names])
            ids.clear()
            done.clear()
            return batch

        for b in batches:
            of = b.schema.field("conv").type
            for c, turn, role, text, lost in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if started and c != conv:
                    ids.append(conv)
                    done.append(report(turns, held))
                    size += sum(len(t) for _, t in held)
                    turns, held = [], []
                    if len(done) >= 1000 or size > 1 << 24:
                        yield out(of)
                        size = 0
                conv, started = c, True
                if not lost:
                    turns.append(turn)
                    held.append((role, text))
        if started:
            ids.append(conv)
            done.append(report(turns, held))
            yield out(of)

    return ranged.mapInArrow(run, f"conv {kind}, {SCHEMA}").withColumnRenamed("conv", conv_col)
