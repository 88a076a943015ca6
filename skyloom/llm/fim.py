"""Fill-in-the-middle examples: a text is cut at two drawn units into prefix, middle and suffix, which are set anew between markers.

A text's bytes are read in blocks of BLOCK bytes. Two Fenwick trees hold how many units and how many code points start in each
block; a descent by powers of two finds the block of a cut and the code points before it, and only that block is searched for the
byte. Units are code points, or words (with the white space that follows; white space before the first word goes with it).

The draw: four groups of eight digits of the sha256 of ``seed:id`` give two cuts, whether the text stays plain, and the form.
Output: ``plain`` the text itself; ``psm`` ``<P>prefix<S>suffix<M>middle``; ``spm`` ``<S>suffix<P>prefix<M>middle``. No marker overlaps
another or a text without markers, so ``restored`` rebuilds the text from output and form alone.

Defined results: null and empty texts are plain and empty (0 units); texts that hold a marker are plain; a null id is drawn as the
empty string; repeated ids are cut at the same draws; an empty table gives no rows; very long texts are read in steps of STEP bytes, so
the trees need 16 bytes a block; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, S, M = b"<P>", b"<S>", b"<M>"
#: Bytes of a block, and of a step in which blocks are counted.
BLOCK, STEP = 4096, 1 << 20
#: Texts of one Arrow slice.
SLICE = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _starts(raw: bytes, at: int, stop: int, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Which of the bytes from ``at`` to ``stop`` start a unit, and which a code point."""
    b = np.frombuffer(raw, np.uint8, stop - at, at)
    points = (b & 0xC0) != 0x80
    if unit == "char":
        return points, points
    space = _SPACE[b]
    before = np.empty_like(space)
    before[1:], before[0] = space[:-1], at == 0 or _SPACE[raw[at - 1]]
    return ~space & before, points


class Cuts:
    """Fenwick trees over the blocks of one text."""

    def __init__(self, raw: bytes, unit: str = "char"):
        self.raw, self.unit = raw, unit
        blocks = -(-len(raw) // BLOCK)
        self.trees = np.zeros((2, blocks + 1), np.int64)
        for at in range(0, len(raw), STEP):
            edges = np.arange(0, min(STEP, len(raw) - at), BLOCK)
            for tree, marks in zip(self.trees, _starts(raw, at, min(at + STEP, len(raw)), unit), strict=True):
                tree[1 + at // BLOCK : 1 + at // BLOCK + len(edges)] = np.add.reduceat(marks, edges, dtype=np.int64)
        self.units, self.points = (int(t.sum()) for t in self.trees)
        # each node takes in the node that ends half its span before it
        step = 1
        while step < blocks:
            nodes = np.arange(2 * step, blocks + 1, 2 * step)
            self.trees[:, nodes] += self.trees[:, nodes - step]
            step *= 2

    def after(self, k: int) -> tuple[int, int]:
        """Byte and code point at which the first ``k`` units have ended."""
        if k == 0 or k == self.units:
            return (0, 0) if k == 0 else (len(self.raw), self.points)
        # the unit that follows starts there: its block has k starts or fewer before it
        block, left, points = 0, k, 0
        step = 1 << (self.trees.shape[1] - 1).bit_length()
        while step := step >> 1:
            if block + step < self.trees.shape[1] and self.trees[0, block + step] <= left:
                block += step
                left -= int(self.trees[0, block])
                points += int(self.trees[1, block])
        at = block * BLOCK
        units, chars = _starts(self.raw, at, min(at + BLOCK, len(self.raw)), self.unit)
        inside = int(np.flatnonzero(units)[left])
        return at + inside, points + int(np.count_nonzero(chars[:inside]))


def draw(name: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(raw: bytes, name: str, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, output."""
    cuts = Cuts(raw, unit)
    h1, h2, h3, h4 = draw(name, seed)
    n = cuts.units
    if not raw or h3 % 100 >= rate or any(m in raw for m in (P, S, M)):
        return n, "plain", None, None, raw
    (a, chars_a), (b, chars_b) = (cuts.after(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form, parts = ("spm", (S, raw[b:], P, raw[:a], M, raw[a:b])) if h4 % 100 < spm else ("psm", (P, raw[:a], S, raw[b:], M, raw[a:b]))
    return n, form, chars_a, chars_b - chars_a, b"".join(parts)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of each row.

    ``rate`` per cent of the texts are cut, of these ``spm`` per cent with the suffix first; ``unit`` is ``char`` or ``word``.
    """
    if unit not in ("char", "word"):
        raise ValueError(f"unknown unit {unit}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                part = whole.slice(lo, SLICE)
                done = [transform(t.as_buffer().to_pybytes(), i.as_py(), seed, rate, spm, unit) for i, t in zip(part.column("name"), part.column("text").cast(pa.binary()), strict=True)]
                *plain, output = zip(*done, strict=True)
                # pieces of valid UTF-8 between its code points are valid UTF-8
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, t) for c, t in zip(plain, kinds, strict=True)], pa.array(output, pa.binary()).cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = (x.decode() for x in (P, S, M))
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
