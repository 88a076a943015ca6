"""Language identification by nearest centroids.

Texts become L2-normalised TF-IDF vectors of hashed letter bigrams and trigrams (lower case, every run of
other characters is one space). Each language's training vectors are clustered by spherical k-means; a text
gets the language of the centroid with the largest cosine. A text is rejected if its cosine distance to that
centroid exceeds the language's radius, which comes from the training distances, or if it has no letter.

The classifier is fitted on a bounded sample: ``per_lang`` distinct labelled texts of each language (all where there are
fewer; less where ``sample_rows`` texts don't suffice for all languages), those with the smallest hashes of their text.
Languages beyond ``max_langs``, those with the fewest distinct texts, are not learned. Only text and label are used. Prediction covers every row and
whole texts, very long ones in pieces whose seams don't show.

Defined results: null texts and texts without a letter get ``und``, score 0, rejected; without any labelled
text every row does; ties go to the language that sorts first; repeated rows get the same result each; an empty table
gives no rows; other columns are ignored, and ``accepted`` keeps them whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 12
PIECE = 1 << 20
CHUNK = 64
UNKNOWN = "und"


@lru_cache(None)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's hashed bigrams and trigrams; None if it has no letter."""
    total, known, size = np.zeros(DIMS, np.int64), False, len(text or "")
    held = np.array([32], np.uint32)  # the last letters of the piece before
    for k in range(0, size, PIECE):
        code = np.frombuffer(text[k : k + PIECE].replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        known |= bool(letter.any())
        c = np.concatenate([held, np.where(letter, code, 32).astype(np.uint32), np.full(int(k + PIECE >= size), 32, np.uint32)])
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        pair = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
        # of two held letters the pair is counted already
        total += np.bincount(pair[len(held) - 1 :] >> np.uint32(20), minlength=DIMS) + np.bincount(triple >> np.uint32(20), minlength=DIMS)
        held = c[-2:]
    return total if known else None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        counts = [gram_counts(t) for t in texts]
        known = [k for k, c in enumerate(counts) if c is not None]
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if known and self.langs:
            x = _unit(np.log1p(np.stack([counts[k] for k in known]).astype(np.float32)) * self.idf)
            cos = x @ self.centroids.T
            for k, best, row in zip(known, cos.argmax(1).tolist(), cos, strict=True):
                score = min(1.0, max(0.0, float(row[best])))
                out[k] = (self.langs[best], score, bool(1 - score > self.radius[best]))
        return out


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of spherical k-means, started from points far from one another."""
    at = [0]
    near = x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, clusters: int = 4, rounds: int = 12, slack: float = 0.3, max_langs: int = 2000, sample_rows: int = 40_000) -> Model:
    """A model from the rows of ``labelled``; per_lang, max_langs and sample_rows bound the sample."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    # copies don't count: the share is one of distinct texts with letters
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not sizes:
        return Model(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    per_lang = min(per_lang, max(1, sample_rows // len(sizes)))
    # of so many texts some are all but sure to be drawn: a language that is learned never lacks a sample
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, max(2 * per_lang, 64) / n))])
    h = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    sample = rows.where(h < share[F.col("lang")]).distinct().select("lang", F.xxhash64("text").alias("h"), "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n := gram_counts(text)) is not None:
                    at = np.flatnonzero(n)
                    out.append((lang, h, at.astype(np.int16).tobytes(), n[at].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "h", "at", "n"])

    found: dict[str, list] = {}
    for r in sorted(sample.mapInArrow(vectors, "lang string, h long, at binary, n binary").collect(), key=lambda r: (r["lang"], r["h"])):
        if len(own := found.setdefault(r["lang"], [])) < per_lang:
            x = np.zeros(DIMS, np.float32)
            x[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.int32)
            own.append(np.log1p(x))
    if not found:
        return Model(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    df = sum((np.stack(v) > 0).sum(0) for v in found.values())
    idf = (np.log((1 + sum(map(len, found.values()))) / (1 + df)) + 1).astype(np.float32)
    langs, centroids, radius = [], [], []
    for lang, v in sorted(found.items()):
        x = _unit(np.stack(v) * idf)
        c = _cluster(x, clusters, rounds)
        nearest = np.quantile((x @ c.T).max(1), 0.002)
        langs += [lang] * len(c)
        centroids.append(c)
        radius += [1 - slack * float(nearest)] * len(c)
    return Model(idf, np.concatenate(centroids).astype(np.float32), langs, np.array(radius))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` of lang_pred, score and rejected; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for k in range(0, len(texts), CHUNK):
                found += shared.value.predict(texts.slice(k, CHUNK).to_pylist())
            columns = [pa.array([r[j] for r in found], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "rejected"])

    return docs.withColumn("language", language(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that the classifier never learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their columns."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    return predict(row, model).where("NOT language.rejected").select("row.*")
