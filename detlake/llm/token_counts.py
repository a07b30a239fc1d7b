"""Token counts of byte-level BPE tokenizers: pairs are merged with a heap over a linked list, only merges are counted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import blobs, per_batch, present

#: Chunks a worker remembers, the longest of them in characters, and chunks of a text looked at together. Bounds of memory, not of results.
REMEMBERED, SHORT, TOGETHER = 500_000, 64, 100_000
#: Largest number of tokens that is within the limit.
LIMIT = 512

# White space with what follows it. Nothing but white space joins with white space before it, so chunks are counted apart.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]+(?:\S|[\x1c-\x1f])*|(?:\S|[\x1c-\x1f])+")
# Fixed value: the words of byte-level tokenizers (contractions, letters, digits, other marks, white space).
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# How byte-level tokenizers write a byte: printable ones as themselves, the others in order from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class TokenCounter:
    """Counts the tokens of texts without making them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        vocab = model["vocab"]
        letters = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
        self.symbol = [vocab[letters[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take their surroundings are not known")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merge(self, data: bytes) -> int:
        """Symbols that are left of one word: its bytes less the merges.

        The heap holds (rank, place of the left symbol) of adjacent pairs. The lowest is merged into its left symbol, the right one
        leaves the list, and the two new neighbours' pairs enter the heap. Entries whose pair is gone are known by their rank.
        """
        rank, symbols, n = self.rank, [self.symbol[b] for b in data], len(data)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue
            symbols[i], symbols[j] = self.merged[r], -1
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h))
        return left

    def _words(self, chunk: str) -> Iterator[str]:
        if max(chunk) < "ɐ":  # beyond Latin, the classes of letters depend on the library's Unicode version
            return (m[0] for m in _WORD.finditer(chunk))
        return (chunk[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(chunk))

    def chunk(self, chunk: str) -> int:
        total = 0
        for w in self._words(chunk):
            n = self.words.get(w)
            if n is None:
                n = self.merge(w.encode())
                if len(w) <= SHORT:
                    if len(self.words) >= REMEMBERED:
                        self.words.clear()
                    self.words[w] = n
            total += n
        return total

    def _segment(self, text: str) -> int:
        total, known = 0, self.chunks
        found = _CHUNK.finditer(text) if len(text) > 8 * TOGETHER else None
        while True:
            some = [m[0] for m in islice(found, TOGETHER)] if found else _CHUNK.findall(text)
            new = {c: self.chunk(c) for c in set(some).difference(known)}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new.update((c, self.chunk(c)) for c in set(some).difference(new))
            known.update(new)
            total += sum(map(known.__getitem__, some))
            for c in new:
                if len(c) > SHORT:
                    del known[c]
            if not found or len(some) < TOGETHER:
                return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; the strings of added tokens are one token each and end the words beside them."""
        if not self.added:
            return self._segment(text)
        parts = self.added.split(text)
        return sum(map(self._segment, parts)) + len(parts) - 1


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per Python worker; its memory of words outlives a task."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` per row of ``docs``: UTF-8 bytes and tokens of the whole text.

    The counts are those of the tokenizers library for the byte-level BPE file ``tokenizer`` without added special tokens, truncation
    or padding; special strings inside a text are one token. Rows are counted where they are read, nothing is shuffled.
    Null and empty texts have no bytes and no tokens; null and repeated ids and repeated rows keep their rows; an empty
    table gives an empty result. Other columns are ignored. A word of any length is merged whole, in n log n steps.
    """

    def run(b: pa.RecordBatch) -> dict:
        own = counter(tokenizer)
        texts = blobs(b, "data")
        n = np.fromiter((own.count(t.decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
        return {"id": b.column("id"), "n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)), "n_tokens": n, "over_limit": n > limit}

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), present(text_col).alias("data"))
    return per_batch(base, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
