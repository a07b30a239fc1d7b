"""Toxicity scores from a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import bounded_sample, per_batch, present

# Closed word classes of the grammar.
INSULTS = (
    "idiot idiots moron morons stupid dumb trash scum loser losers clown pathetic worthless disgusting imbecile jerk retard filth "
    "dumm trottel abschaum versager schwein dreckig imbécile crétin ordure minable pourriture imbécil estúpido basura inútil escoria"
).split()
THREATS = "kill hurt destroy attack burn shoot stab beat punish crush".split()
TARGETS = "you your u he she they them him her his their people everyone du ihr sie tu vous ils elles usted ustedes ellos ellas".split()
NEGATIONS = "not no never none nobody isn't aren't don't nicht kein keine nie pas jamais aucun nunca nada".split()
REPORTING = "said says say wrote writes claimed claims called reported quoted sagte dit dice dijo".split()

#: Rows with these lengths of word beginnings are counted as stems, besides whole words.
STEMS = (4, 5, 6)
#: Words that must stand before a stem in toxic texts (as bits of a 64-bit map: copies of one text add none), and how much
#: likelier it must be there, to become an insult.
SUPPORT, LIFT = 5, 20.0
#: A stem of whose toxic texts this share holds one longer stem or word adds nothing but chance finds, and is left out.
EXPLAINED = 0.9
#: Weight of the fixed insults, unless labelled texts say more or, by occurring in more clean than toxic ones, the contrary.
PRIOR = 4.0
#: Labelled rows that the grammar is fitted on at most; the sample is taken by a hash of the id.
LABELLED_ROWS = 200_000

_CLAUSE = re.compile(r"[.!?;:,\n]+")
_WORD = re.compile(r"[^\W\d_][\w']*")

# Symbols of the clause alphabet.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What governs a clause: nothing, a negation, reported speech, or negated reported speech, and what an insult or threat counts then.
PLAIN, NEGATED, REPORTED, DENIED = range(4)
GOVERNED = {(PLAIN, NEGATION): NEGATED, (PLAIN, REPORT): REPORTED, (NEGATED, REPORT): DENIED, (REPORTED, NEGATION): DENIED}
FACTOR = {PLAIN: 1.0, NEGATED: 0.6, REPORTED: 0.7, DENIED: 0.4}
#: How far a threat is: no part of it, a target, a threat that waits for its target, or a target that threatens and may name another.
#: (state, symbol) -> (next state, share of a threat that is complete there).
FREE, AIMED, PENDING, ACTING = range(4)
THREATENED = {
    (FREE, TARGET): (AIMED, 0.0), (FREE, THREAT): (PENDING, 0.0), (PENDING, TARGET): (AIMED, 1.0),
    (AIMED, THREAT): (ACTING, 0.5), (ACTING, TARGET): (AIMED, 0.5),
}
#: Composed transducer: (state, symbol) -> (next state, factor on the weight of an insult or threat read there).
ARCS = {}
for _g, _factor in FACTOR.items():
    for _a in (FREE, AIMED, PENDING, ACTING):
        for _s in (INSULT, THREAT, TARGET, NEGATION, REPORT):
            _next, _share = THREATENED.get((_a, _s), (_a, 0.0))
            if _s == INSULT:
                _share = 1.5 if _g == PLAIN and _a in (AIMED, ACTING) else 1.0
            ARCS[(_g, _a), _s] = (GOVERNED.get((_g, _s), _g), _next), _share * _factor
_CLOSED = {w: s for s, group in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING)) for w in group}


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked as such."""
    return [word, *(word[:k] + "~" for k in STEMS if len(word) > k)]


class Grammar:
    """Insult arcs with learned weights, and the map from a document's clause weights to a probability."""

    def __init__(self, insults: dict[str, float], slope: float = 1.0, offset: float = 0.0):
        self.insults, self.slope, self.offset = insults, slope, offset
        self.seen: dict[str, float] = {}

    def insult(self, word: str) -> float:
        weight = self.seen.get(word)
        if weight is None:
            weight = max((self.insults.get(f, 0.0) for f in features(word)), default=0.0)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = weight
        return weight

    def clause(self, tokens: list[str]) -> float:
        """Weight of the best path: what an insult or threat counts under what governs it."""
        state, total = (PLAIN, FREE), 0.0
        for t in tokens:
            weight = self.insult(t)
            symbol = INSULT if weight else _CLOSED.get(t, OTHER)
            state, factor = ARCS.get((state, symbol), (state, 0.0))
            total += factor * (weight or 1.0)
        return total

    def weight(self, text: str) -> float:
        """Sum over the clauses that hold an insult or threat; other clauses never reach the transducer."""
        text = text.lower()
        if not any(self.insult(w) or _CLOSED.get(w) == THREAT for w in set(_WORD.findall(text))):
            return 0.0
        return sum(self.clause(_WORD.findall(c)) for c in _CLAUSE.split(text))

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.offset + self.slope * np.log1p(self.weight(text)), -50, 50))))


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly regularised logistic fit on grouped rows (value, rows, positive rows)."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - n * p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> Grammar:
    """Learn the insult arcs and the calibration from labelled documents for which ``training`` (over ``id_col``) holds.

    The insults are counted over all these documents; the calibration is fitted on a third of them with the insults that the other
    two thirds give. At most ``rows`` labelled ids are used, the first by hash; that many 9-byte rows are the proven bound of the broadcast.
    Without toxic or without clean rows only the fixed insults are known.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).where(training)
    known = bounded_sample(known.select(F.col(id_col).cast("long").alias("d"), (F.col("toxic") == 1).alias("toxic")), rows, "d", "toxic")
    texts = docs.select(F.col(id_col).cast("long").alias("d"), present(text_col).alias("data")).join(F.broadcast(known), "d")
    texts = texts.select("data", "toxic", (F.pmod(F.xxhash64(F.lit(5), "data"), F.lit(3)) == 0).alias("aside"))

    def count(b: pa.RecordBatch) -> dict:
        # per feature: clean and toxic texts, words before it in toxic ones; the same over the texts not set aside
        seen: dict[str, list[int]] = {"": [0] * 6}  # under a name that is no word: rows of the class itself
        for text, toxic, aside in zip(*(b.column(c).to_pylist() for c in ("data", "toxic", "aside")), strict=True):
            tokens = _WORD.findall(text.decode("utf-8", "replace").lower())
            parts = (0,) if aside else (0, 3)
            for f in {"", *(f for w in set(tokens) for f in features(w))}:
                own = seen.setdefault(f, [0] * 6)
                for p in parts:
                    own[p + toxic] += 1
            if toxic:
                for before, w in {*zip(["", *tokens], tokens, strict=False)}:
                    bit = 1 << (crc32(before.encode()) & 63)
                    for f in features(w):
                        for p in parts:
                            seen[f][p + 2] |= bit
        columns = np.array(list(seen.values()), np.uint64).view(np.int64).T
        return {"feature": list(seen)} | {f"c{i}": columns[i] for i in range(6)}

    counts = per_batch(texts, count, "feature string, " + ", ".join(f"c{i} long" for i in range(6)))
    merged = [(F.bit_or if i in (2, 5) else F.sum)(f"c{i}").alias(f"c{i}") for i in range(6)]
    often = [(F.bit_count(f"c{p + 2}") >= SUPPORT) & (F.col(f"c{p + 1}") > F.col(f"c{p}")) for p in (0, 3)]
    wanted = (F.col("feature") == "") | F.col("feature").isin(INSULTS) | often[0] | often[1]
    rows_found = counts.groupBy("feature").agg(*merged).where(wanted).collect()
    grammar = Grammar(_insults([(r.feature, r.c0, r.c1, r.c2) for r in rows_found]))
    trial = Grammar(_insults([(r.feature, r.c3, r.c4, r.c5) for r in rows_found]))

    def weigh(b: pa.RecordBatch) -> dict:
        return {"x": [round(float(np.log1p(trial.weight(t.decode("utf-8", "replace")))), 2) for t in b.column("data").to_pylist()], "toxic": b.column("toxic")}

    def histogram(some: DataFrame) -> np.ndarray:
        hist = per_batch(some.select("data", "toxic"), weigh, "x double, toxic boolean").groupBy("x")
        return np.array(hist.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).collect(), float).reshape(-1, 3)

    # how much weight is toxic shows on texts that the trial's insults were not learned from
    hist = histogram(texts.where("aside"))
    if not 0 < hist[:, 2].sum() < hist[:, 1].sum():
        hist = histogram(texts)
    if len(hist):
        grammar.slope, grammar.offset = _logistic(*hist.T)
    return grammar


def _insults(found: list[tuple[str, int, int, int]]) -> dict[str, float]:
    """Weights by feature from counted rows (feature, clean texts, toxic texts, bits of the words before it)."""
    clean, toxic = next(((c, t) for f, c, t, _ in found if not f), (0, 0))
    out = dict.fromkeys(INSULTS, PRIOR)
    for f, c, t, _ in found:
        if f in out and c > t:
            del out[f]
    likely = [(f, c, t) for f, c, t, before in found if f and (before & (1 << 64) - 1).bit_count() >= SUPPORT and t > c] if clean and toxic else []
    longer: dict[str, int] = {}
    for f, _, t in likely:
        word = f.rstrip("~")
        for k in STEMS:
            if len(word) > k:
                longer[word[:k] + "~"] = max(longer.get(word[:k] + "~", 0), t)
    for f, c, t in likely:
        lift = (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))
        if lift >= LIFT and longer.get(f, 0) < EXPLAINED * t:
            out[f] = max(float(np.log(lift)), out.get(f, 0.0))
    return out


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All rows of ``docs`` with the probability that the text is toxic, in a column ``name`` (which it replaces).

    Null and empty texts have no matched clause and get the score of a text without insults. Whole texts are scored.
    """
    grammar.seen = {}
    inner = docs.select(present(text_col).alias("data"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("rest"))

    def run(b: pa.RecordBatch) -> dict:
        return {"rest": b.column("rest"), "s": pa.array([grammar.score(t.decode("utf-8", "replace")) for t in b.column("data").to_pylist()], pa.float64())}

    out = per_batch(inner, run, f"rest {inner.schema['rest'].dataType.simpleString()}, s double")
    return out.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != name], F.col("s").alias(name))


