"""Document likelihoods from a gated recurrent language model with a class-factored output."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import per_batch, present

#: The end of a text as a token; it holds a separator, so no word equals it.
END = b"\n"
#: Words with a known count in every task (a bound of the broadcast), words with an output of their own, words of a
#: class of those, and classes of all other words.
LISTED, FREQUENT, CLASS, OTHERS = 100_000, 2048, 64, 96
#: Hidden units, steps of a truncated window, texts side by side in training and in scoring.
HIDDEN, WINDOW, TRAIN_LANES, LANES = 24, 24, 48, 512
#: Rounds of training, each over another share of the training texts (together all of them), and texts of one replica on average.
ROUNDS, REPLICA = 4, 1500
#: Weight given to every word and to one unseen word of a class.
SMOOTH = 0.1


def other_class(word: bytes, classes: int = OTHERS) -> int:
    """Class of a word without an output of its own, by how it begins."""
    return crc32(word[:3]) % classes


@dataclass
class Vocabulary:
    """Counts of the listed words, by rank, and totals of the classes of all others."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    other_tokens: np.ndarray
    other_types: np.ndarray
    frequent: int = field(init=False)

    def __post_init__(self):
        self.frequent = min(FREQUENT, len(self.words))
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.other_of = np.array([other_class(w) for w in self.words], np.int32)

    def symbol(self, rank: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Input and output symbol: the rank of a frequent word, else its class behind them."""
        listed = np.where(rank < self.frequent, rank, FREQUENT + self.other_of[rank]) if len(self.words) else FREQUENT + others
        return np.where(rank >= 0, listed, FREQUENT + others).astype(np.int32)

    def other_weight(self) -> np.ndarray:
        return self.other_tokens + SMOOTH * (self.other_types + 1)


CLASSES = FREQUENT // CLASS + OTHERS
SYMBOLS = FREQUENT + OTHERS


def initial(v: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output biases start as the smoothed class and word frequencies."""
    r = np.random.default_rng(seed)
    n = np.zeros(FREQUENT) + SMOOTH
    n[: v.frequent] += v.counts[: v.frequent]
    of_class = np.concatenate([n.reshape(-1, CLASS).sum(1), v.other_weight()])
    p = {
        "wx": r.normal(0, 0.1, (SYMBOLS, 3 * HIDDEN)), "uh": r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), "bx": np.zeros(3 * HIDDEN),
        "wc": r.normal(0, 0.05, (HIDDEN, CLASSES)), "bc": np.log(of_class / of_class.sum()),
        "ww": r.normal(0, 0.02, (FREQUENT, HIDDEN)), "bw": np.log(n / np.repeat(n.reshape(-1, CLASS).sum(1), CLASS)),
    }
    return {k: x.astype(np.float32) for k, x in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(p: dict, symbols: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states after each of the (time, lane) input symbols, from the carried state ``h``."""
    out = np.empty((*symbols.shape, HIDDEN), np.float32)
    x = p["wx"][symbols] + p["bx"]
    for t in range(len(symbols)):
        u = h @ p["uh"]
        gates = _sigmoid(x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, u[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def output_class(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < FREQUENT, symbols // CLASS, symbols - FREQUENT + FREQUENT // CLASS)


def _normal(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums per row. Logits stay small (frequencies and clipped steps), so none overflows."""
    e = np.exp(logits)
    return e, e.sum(axis=1)


def outputs(p: dict, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target symbol after the states ``h`` (rows), and with ``grads`` the gradient at ``h``.

    First the class out of all, then the word out of its class; other words end with their class.
    """
    row = np.arange(len(h))
    cls = output_class(target)
    logits = h @ p["wc"] + p["bc"]
    prob, z = _normal(logits)
    logp = logits[row, cls] - np.log(z)
    back = None
    if grads is not None:
        prob /= z[:, None]
        prob[row, cls] -= 1
        grads["wc"] += h.T @ prob
        grads["bc"] += prob.sum(0)
        back = prob @ p["wc"].T
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(FREQUENT // CLASS + 1))
    for c in np.flatnonzero(np.diff(ends)):
        at = order[ends[c] : ends[c + 1]]
        words = slice(c * CLASS, (c + 1) * CLASS)
        within = target[at] - c * CLASS
        own = np.arange(len(at))
        logits = h[at] @ p["ww"][words].T + p["bw"][words]
        prob, z = _normal(logits)
        logp[at] += logits[own, within] - np.log(z)
        if grads is not None:
            prob /= z[:, None]
            prob[own, within] -= 1
            grads["ww"][words] += prob.T @ h[at]
            grads["bw"][words] += prob.sum(0)
            back[at] += prob @ p["ww"][words]
    return logp, back


class Lanes:
    """Texts side by side in windows of some steps; a lane whose text ends takes the next one, with a fresh state."""

    def __init__(self, texts: list[np.ndarray], lanes: int, window: int):
        self.length = np.array([len(t) for t in texts])
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        self.queue = np.argsort(-self.length, kind="stable")
        self.lanes, self.window = lanes, window

    def windows(self, start: int) -> Iterator[tuple]:
        """Inputs, targets and validity of each window, texts of the lanes, and the state; the state must be stored back in it."""
        text = np.zeros(0, np.int64)
        place = np.zeros(0, np.int64)
        state = [np.zeros((0, HIDDEN), np.float32)]
        taken = 0
        while True:
            live = place < self.length[text]
            text, place, state[0] = text[live], place[live], state[0][live]
            more = self.queue[taken : taken + self.lanes - len(text)]
            taken += len(more)
            text, place = np.append(text, more), np.append(place, np.zeros(len(more), np.int64))
            state[0] = np.concatenate([state[0], np.zeros((len(more), HIDDEN), np.float32)])
            if not len(text):
                return
            steps = int(min(self.window, (self.length[text] - place).max()))
            at = place + np.arange(steps)[:, None]
            valid = at < self.length[text]
            index = np.where(valid, at + self.offset[text], 0)
            target = self.flat[index]
            inputs = np.where(at > 0, self.flat[index - 1], start)
            yield inputs, target, valid, text, state
            place = place + steps


def log10_likelihoods(p: dict, texts: list[np.ndarray], start: int) -> np.ndarray:
    """log10 probability of each whole symbol sequence; the state is carried from window to window."""
    total = np.zeros(len(texts))
    for inputs, target, valid, text, state in Lanes(texts, LANES, WINDOW).windows(start):
        hidden = forward(p, inputs, state[0])
        state[0] = hidden[-1]
        logp, _ = outputs(p, hidden[valid], target[valid])
        total += np.bincount(np.broadcast_to(text, valid.shape)[valid], logp, len(texts))
    return total / math.log(10)


def train(p: dict, texts: list[np.ndarray], start: int, rate: float = 0.01) -> int:
    """One pass of truncated backpropagation over the texts, changing ``p``; returns the number of targets seen."""
    first = {k: np.zeros_like(x) for k, x in p.items()}
    second = {k: np.zeros_like(x) for k, x in p.items()}
    seen = step = 0
    for inputs, target, valid, _, state in Lanes(texts, TRAIN_LANES, WINDOW).windows(start):
        kept: list = []
        hidden = forward(p, inputs, state[0], kept)
        state[0] = hidden[-1]
        g = {k: np.zeros_like(x) for k, x in p.items()}
        n = int(valid.sum())
        back = np.zeros_like(hidden)
        back[valid] = outputs(p, hidden[valid], target[valid], g)[1]
        dx = np.empty((*inputs.shape, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(state[0])
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, un = kept[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            g["uh"] += before.T @ du
            dh = dh * z + du @ p["uh"].T
        g["bx"] = dx.sum((0, 1))
        np.add.at(g["wx"], inputs.ravel(), dx.reshape(-1, 3 * HIDDEN))
        step += 1
        for k in p:
            d = np.clip(g[k] / n, -1, 1)
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.01 * (d * d - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        seen += n
    return seen


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts, the end token included; counted within a batch before the shuffle."""

    def run(b: pa.RecordBatch) -> dict:
        seen: dict[bytes, int] = {END: b.num_rows}
        get = seen.get
        for t in b.column("data").to_pylist():
            for w in t.lower().split():
                seen[w] = get(w, 0) + 1
        return {"word": pa.array(seen, pa.binary()), "n": pa.array(seen.values(), pa.int64())}

    return per_batch(texts.select("data"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, at most LISTED, and the totals of the rest. The end token is always among the first.

    How many words are how frequent is counted first (in steps of a 64th of a power of two), so that no task sends more than
    it has of the listed words.
    """
    size = F.floor(F.log2("n") * 64)
    listed, least = 0, 1 << 62
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("v")).collect(), reverse=True):
        if listed + r.v >= LISTED:
            break
        listed, least = listed + r.v, r["size"]
    top = counts.where((size >= least) | (F.col("word") == END)).collect()
    top.sort(key=lambda r: (-r.n, bytes(r.word)))
    if END not in (bytes(r.word) for r in top[:FREQUENT]):
        top.sort(key=lambda r: bytes(r.word) != END)
    cls = F.pmod(F.crc32(F.substring("word", 1, 3)), F.lit(OTHERS)).cast("int")
    tokens, types = np.zeros(OTHERS), np.zeros(OTHERS)
    for r in counts.groupBy(cls.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r.c], types[r.c] = r.n, r.v
    v = Vocabulary([bytes(r.word) for r in top], np.array([r.n for r in top], np.float64), int(tokens.sum()), int(types.sum()), tokens, types)
    # words with an output of their own are no part of the other classes
    np.subtract.at(v.other_tokens, v.other_of[: v.frequent], v.counts[: v.frequent])
    np.subtract.at(v.other_types, v.other_of[: v.frequent], 1)
    return v


def _average(weights: DataFrame) -> DataFrame:
    """Mean of the replicas' weights, chunk by chunk, 64 replicas at a time."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.n.to_numpy()
        values = np.stack([np.frombuffer(x, np.float32) for x in rows["values"]])
        total = (values * n[:, None]).sum(0) / n.sum()
        return pd.DataFrame({"chunk": [rows.chunk.iloc[0]], "replica": [rows.replica.iloc[0] // 64], "n": [n.sum()], "values": [total.astype(np.float32).tobytes()]})

    kind = "chunk int, replica long, n double, values binary"
    for _ in range(3):  # 64**3 replicas and more end as a bounded group
        weights = weights.groupBy("chunk", F.expr("replica div 64").alias("part")).applyInPandas(mean, kind)
    return weights.groupBy("chunk").applyInPandas(mean, kind)


def fit(texts: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Train once on each of ``texts`` (key, data): replicas start each round from the same weights, see their own texts, and are
    averaged with the number of their tokens as weight. Their number grows with the texts, so a replica's work doesn't."""
    p = initial(v)
    if not v.words:
        return p
    spark = texts.sparkSession
    shapes = {k: x.shape for k, x in p.items()}
    start = v.rank[END]
    for turn in range(ROUNDS):
        some = texts.where(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(ROUNDS)) == turn)
        replicas = max(1, -(-some.count() // REPLICA))
        held = spark.sparkContext.broadcast((p, v))

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            own, words = held.value
            own = {k: x.copy() for k, x in own.items()}
            n = train(own, [encode(t, words)[0] for t in rows.column("data").to_pylist()], start)
            flat = np.concatenate([x.ravel() for x in own.values()])
            chunks = [flat[a : a + 4096].tobytes() for a in range(0, len(flat), 4096)]
            return pa.table(
                {
                    "chunk": pa.array(range(len(chunks)), pa.int32()), "replica": pa.array([key[0].as_py()] * len(chunks), pa.int64()),
                    "n": pa.array([float(n)] * len(chunks)), "values": pa.array(chunks, pa.binary()),
                }
            )

        dealt = some.select("data", F.pmod(F.xxhash64(F.lit(13), "key"), F.lit(replicas)).alias("replica")).groupBy("replica")
        out = _average(dealt.applyInArrow(run, "chunk int, replica long, n double, values binary")).orderBy("chunk").collect()
        if not out:
            continue
        flat, at = np.concatenate([np.frombuffer(r["values"], np.float32) for r in out]), 0
        for k, shape in shapes.items():
            n = math.prod(shape)
            p[k] = flat[at : at + n].reshape(shape).copy()
            at += n
    return p


def encode(text: bytes, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Symbols and ranks of a text's tokens with the end (rank -1: not listed), and its unlisted words."""
    words = text.lower().split()
    words.append(END)
    get = v.rank.get
    rank = np.array([get(w, -1) for w in words], np.int64)
    off = np.flatnonzero(rank < 0).tolist()
    unlisted = [words[i] for i in off]
    others = np.zeros(len(words), np.int64)
    others[off] = [other_class(w) for w in unlisted]
    return v.symbol(rank, others), rank, unlisted


def _log(x) -> Column:
    return F.log10(x)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, whether it was held out, token counts, the smoothed unigram score and the model's, both log10.

    Rows for which ``training`` (a condition on ``docs``) holds are counted and train the weights. A token is a
    lower-cased word or the end of the text. The model gives P(class | what came before), times P(word | class, before) for frequent words
    and the word's smoothed share of its class for the others, unseen words included, so the probabilities of all words add
    up to one. Counts of the LISTED most frequent words travel with the model; rarer words are joined with the counts.

    Null and empty texts consist of the end alone. Null ids and a null condition count as held out; repeated rows are scored one by
    one. Without any training text the model is uniform over its symbols.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), present(text_col).alias("data"))
    learning = rows.where("training").select(F.xxhash64("id").alias("key"), "data")
    counts = materialize(count_words(learning), "counts")
    v = vocabulary(counts)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((fit(learning, v), v))

    def run(b: pa.RecordBatch) -> dict:
        p, words = held.value
        symbols, tokens, known, base, model, rare = [], [], [], [], [], []
        weight = np.log10(words.other_weight())
        logs = np.log10(words.counts + SMOOTH)
        for t in b.column("data").to_pylist():
            s, rank, unlisted = encode(t, words)
            listed = rank[rank >= 0]
            symbols.append(s)
            tokens.append(len(s))
            known.append(len(listed))
            base.append(float(logs[listed].sum()))
            # words without an output of their own: their share of the class, as far as it is known here
            other = s[s >= FREQUENT] - FREQUENT
            model.append(float(logs[listed[listed >= words.frequent]].sum() - weight[other].sum()))
            rare.append(np.array([xxhash.xxh64_intdigest(w, 42) for w in unlisted], np.uint64).view(np.int64))
        out = log10_likelihoods(p, symbols, words.rank.get(END, FREQUENT + other_class(END)))
        return {
            "id": b.column("id"), "training": b.column("training"), "n": pa.array(tokens, pa.int64()), "known": pa.array(known, pa.int64()),
            "base": pa.array(base, pa.float64()), "model": pa.array(np.array(model) + out), "rare": pa.array(rare, pa.list_(pa.int64())),
        }

    kind = rows.schema["id"].dataType.simpleString()
    first = per_batch(rows, run, f"id {kind}, training boolean, n long, known long, base double, model double, rare array<long>")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    seen = counts.select(F.xxhash64("word").alias("h"), F.col("n").alias("c"))
    rare = first.select("row", F.explode("rare").alias("h")).join(seen.hint("shuffle_hash"), "h", "left")
    rare = rare.groupBy("row").agg(F.sum(_log(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.count("c").alias("found"))
    out = first.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    floor = math.log10(v.tokens + SMOOTH * (v.types + 1))
    return out.select(
        F.col("id").alias(id_col), (~F.col("training")).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * floor).alias("base_score"), (F.col("model") + more).alias("score"),
    )
