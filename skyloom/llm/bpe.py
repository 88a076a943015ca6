"""Byte-pair encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every new word. A proposal is the exact encoding when each token
is what merging makes of its own letters and no merge would have crossed any boundary between neighbours. Both
are tested for all boundaries at once: the sides of a boundary are undone merge by merge, latest first, until
a pair across the boundary merges earlier than what stood there (the proposal fails) or single letters are
left (it holds). Only words that fail are merged exactly. Words recur, so each worker keeps a bounded table of
solved words.

Defined results: null and empty texts have no tokens and decode to the empty string; special strings inside a
text become their special token; ids that the vocabulary lacks are left out when decoding; repeated rows are encoded each;
of equal merges in a word the left one goes first; very long texts are encoded whole, CHUNK rows of a batch at a time; an empty
table gives no rows. Other columns of the input pass, but one that has the name of an output column (``ids_col``,
``decoded_col``) is replaced by it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyloom.llm.words import SPECIAL, letters, words

END = "</w>"
#: Solved words that a worker keeps; the table is emptied when it is full.
MAX_WORDS = 200_000
#: Texts that are split before their new words are solved together.
CHUNK = 128


class Bpe:
    """Vocabulary and merges of a tokenizer file; token ids follow the order of the merges."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = len(self.vocab)
        self.base = size - len(merges)
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        keys = np.empty(len(merges), np.int64)
        for k, (a, b) in enumerate(merges):
            self.left[self.base + k], self.right[self.base + k] = x, y = self.vocab[a], self.vocab[b]
            keys[k] = x * size + y
            if self.vocab[a + b] != self.base + k:
                raise ValueError("token ids must follow the order of the merges")
        self.size, order = size, np.argsort(keys)
        self.keys, self.made = keys[order], self.base + order
        self.merge = {int(k): self.base + i for i, k in enumerate(keys)}
        self.names = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            body = t.removesuffix(END)
            self.reach[body[:2]] = max(self.reach.get(body[:2], 1), len(body))
        # a token holds if both parts hold and nothing merges across them before they merge
        made = np.arange(self.base, size)
        holds = np.ones(size, bool)
        apart = self.apart(self.left[made], self.right[made], made)
        for t, ok in zip(made.tolist(), apart.tolist(), strict=True):
            holds[t] = ok and holds[self.left[t]] and holds[self.right[t]]
        self.holds = holds
        self.solved: dict[str, tuple[int, ...]] = {}

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: True if no merge crosses their boundary (before token ``limit`` is made)."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), self.size, np.int64) if limit is None else limit.copy()
        while len(at):
            key = a * self.size + b
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[pos] == key) & (self.made[pos] < limit)
            out[at[crossed]] = False
            on = ~crossed & (np.maximum(a, b) >= self.base)
            at, a, b, limit = at[on], a[on], b[on], limit[on]
            first = a > b
            # of equal merges the left one happens first: it is undone last, and a pair that ties with it loses
            limit = np.where(first, np.minimum(limit, a), np.minimum(limit, b + 1))
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def greedy(self, text: str) -> list[int]:
        """Longest-match tokens of a word's letters; the last letter carries the end mark."""
        out, start, n, vocab, reach = [], 0, len(text), self.vocab, self.reach
        while start < n:
            stop = min(n, start + reach.get(text[start : start + 2], 1))
            while (t := vocab.get(text[start:stop] + END if stop == n else text[start:stop])) is None:
                stop -= 1
            out.append(t)
            start = stop
        return out

    def exact(self, text: str) -> list[int]:
        """The tokens that merging in order of rank, leftmost first, makes."""
        tok = [self.vocab[c] for c in text[:-1]] + [self.vocab[text[-1] + END]]
        n = len(tok)
        if n <= 40:
            return self._exact_short(tok)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := self.merge.get(tok[i] * self.size + tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = nxt[i] if tok[i] >= 0 else n
            if j >= n or self.merge.get(tok[i] * self.size + tok[j]) != m:
                continue
            tok[i], tok[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (x := self.merge.get(m * self.size + tok[nxt[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if prev[i] >= 0 and (x := self.merge.get(tok[prev[i]] * self.size + m)) is not None:
                heapq.heappush(heap, (x, prev[i]))
        return [t for t in tok if t >= 0]

    def _exact_short(self, tok: list[int]) -> list[int]:
        """The same for few letters, without a heap."""
        get, size, none = self.merge.get, self.size, self.size
        made = [get(a * size + b, none) for a, b in zip(tok, tok[1:], strict=False)]
        while made and (m := min(made)) < none:
            i = made.index(m)
            tok[i : i + 2] = [m]
            del made[i]
            if i < len(made):
                made[i] = get(m * size + tok[i + 1], none)
            if i:
                made[i - 1] = get(tok[i - 1] * size + m, none)
        return tok

    def solve(self, new: list[str]) -> None:
        """Adds the encodings of new words to the table."""
        texts = [letters(w) for w in new]
        guess = [self.greedy(t) for t in texts]
        flat = np.fromiter(chain.from_iterable(guess), np.int64)
        word = np.repeat(np.arange(len(new)), np.fromiter(map(len, guess), np.int64, len(guess)))
        fails = np.zeros(len(new), bool)
        fails[word[~self.holds[flat]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, where = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fails[word[inside[~self.apart(pairs // self.size, pairs % self.size)[where]]]] = True
        for k in np.flatnonzero(fails).tolist():
            guess[k] = self.exact(texts[k])
        self.solved.update(zip(new, map(tuple, guess), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [words(t) for t in texts]
        if len(self.solved) > MAX_WORDS:
            self.solved = {}
        self.solved.update({w: (i,) for w, i in self.special.items()})
        new = list(set(chain.from_iterable(split)) - self.solved.keys())
        if new:
            self.solve(new)
        return [list(chain.from_iterable(map(self.solved.__getitem__, ws))) for ws in split]

    def decode(self, ids: list[int] | None) -> str:
        get = self.names.get
        return " ".join([t for i in ids or () if (t := get(i)) is not None])


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    """One model per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def _with(batch: pa.RecordBatch, name: str, values: pa.Array, drop: str | None = None) -> pa.RecordBatch:
    cols = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (name, drop)}
    return pa.RecordBatch.from_pydict(cols | {name: values})


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``text_col`` replaced by its token ids in ``ids_col``."""
    fields = [f for f in df.schema.fields if f.name not in (text_col, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(k, CHUNK)
                ids = bpe.encode_batch(batch.column(text_col).to_pylist())
                yield _with(batch, ids_col, pa.array(ids, pa.list_(pa.int32())), text_col)

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col`` replaced by its token ids and the text that these decode to, in one pass of one worker."""
    fields = [f for f in df.schema.fields if f.name not in (text_col, ids_col, decoded_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(k, CHUNK)
                ids = bpe.encode_batch(batch.column(text_col).to_pylist())
                out = _with(batch, ids_col, pa.array(ids, pa.list_(pa.int32())), text_col)
                yield _with(out, decoded_col, pa.array(map(bpe.decode, ids), pa.string()))

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` added in ``text_col``."""
    fields = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(k, CHUNK)
                ids = batch.column(ids_col)
                flat, size = ids.flatten().to_numpy(zero_copy_only=False).tolist(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                stop = np.cumsum(size).tolist()
                yield _with(batch, text_col, pa.array([bpe.decode(flat[i - n : i]) for i, n in zip(stop, size.tolist(), strict=True)], pa.string()))

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType())]))


__all__ = ["SPECIAL", "Bpe", "decode", "encode", "model", "round_trip"]
