"""Greedy word-piece counts by a linear longest-match automaton.

A trie holds the vocabulary. Every node has a failure link and the number of pieces that are popped when the
scan leaves it by that link, so a word is counted in one pass over its letters without building pieces or
looking back. Every single letter, with or without the end mark, must be in the vocabulary.

Defined results: null and empty texts count 0; special strings count as one word of one token; repeated rows
are counted each; of pieces that match at a place the longest counts, so nothing ties; very long texts are split whole, 256 rows
of a batch at a time, and a very long word is one pass; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.words import SPECIAL, byte_letters, letters, words

END = "</w>"
MAX_WORDS = 400_000
CHUNK = 256


class Automaton:
    def __init__(self, path: str):
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        if lacking := [c for c in byte_letters() if c not in vocab or c + END not in vocab]:
            raise ValueError(f"letters without a piece: {lacking[:5]}")
        step: list[dict[str, int]] = [{}]
        whole = [False]
        for token in vocab:
            ended = token.endswith(END) and token != END
            body = token.removesuffix(END) if ended else token
            units = [*body[:-1], body[-1] + END] if ended else list(body)
            node = 0
            for u in units:
                if u not in step[node]:
                    step[node][u] = len(step)
                    step.append({})
                    whole.append(False)
                node = step[node][u]
            whole[node] = True
        pops, fail = [0] * len(step), [0] * len(step)
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for u, node in step[up].items():
                queue.append(node)
                if whole[node]:
                    pops[node], fail[node] = 1, 0
                    continue
                n, at = pops[up], fail[up]
                while u not in step[at]:
                    n, at = n + pops[at], fail[at]
                pops[node], fail[node] = n, step[at][u]
        self.step, self.pops, self.fail = step, pops, fail
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Greedy longest-match pieces of a word."""
        step, pops, fail = self.step, self.pops, self.fail
        text = letters(word)
        n = node = 0
        for u in chain(text[:-1], (text[-1] + END,)):
            while (to := step[node].get(u)) is None:
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            n += pops[node]
            node = fail[node]
        return n

    def counts(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """Words, tokens and the most tokens of a word, for each text."""
        split = [words(t) for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known = {}
        self.known.update(dict.fromkeys(SPECIAL, 1))
        for w in set(chain.from_iterable(split)) - self.known.keys():
            self.known[w] = self.count(w)
        each = [list(map(self.known.__getitem__, ws)) for ws in split]
        return [(len(ns), sum(ns), max(ns, default=0)) for ns in each]


_AUTOMATA: dict[str, Automaton] = {}


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_tokens, longest_word (its tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _AUTOMATA:
            _AUTOMATA[path] = Automaton(path)
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(k, CHUNK)
                n = np.array(_AUTOMATA[path].counts(batch.column(1).to_pylist()), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n.T)], names=[id_col, "n_words", "n_tokens", "longest_word"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, longest_word long")
