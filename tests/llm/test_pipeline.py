"""The pipeline against its stages done by hand."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    from tests.llm.test_text_operators import brute_groups

    from skyloom.llm.common import durable

    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9_000_000 + k, t, None, None, None) for k, t in enumerate([None, "", "12345 !!", "漢字仮名交じり文"])]
    docs = start.unionByName(spark.createDataFrame(odd, start.schema))
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        after.append(docs)
    known, once, alone, mixed, tokens = after
    assert all(d.columns == start.columns for d in after[:4])
    assert known.where("doc_id >= 9000000").count() == 0 and known.count() >= 0.99 * start.count()
    best = {}
    for r in known.collect():
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(best.values())
    want = {c for _, _, c in brute_groups([(r["doc_id"], r["text"]) for r in once.collect()], 5, 4, 5)}
    assert {r["doc_id"] for r in alone.collect()} == want
    own = {r["doc_id"]: collections.Counter(r["text"].split()) for r in alone.collect()}
    taken = collections.defaultdict(collections.Counter)
    for r in mixed.collect():
        taken[r["doc_id"]].update(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 2 * own[i][w] for i, c in taken.items() for w, n in c.items())
    size = sum(sum(c.values()) for c in own.values())
    assert sum(sum(c.values()) for c in taken.values()) == pytest.approx(1.5 * size, rel=0.02)
    assert tokens.count() == mixed.count()


def test_last_stage_counts_tokens(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    from skyloom.llm.queries import vocabulary

    library = tokenizers.Tokenizer.from_file(vocabulary())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, docs, sf_dir).collect():
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0 and re.match("doc_id", docs.columns[0])


def test_odd_rows_through_all_stages(spark, sf_dir):
    """Extra columns with names that the operators use, repeated rows and ids, nulls, and a very long text."""
    from skyloom.llm.common import durable

    start = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    one = start.first()
    long = " ".join(f"{one['text'].split()[k % 40]} the and of" for k in range(60_000))
    odd = [(9_000_000, long, "en", "s", len(long)), (9_000_001, None, None, None, None), (9_000_002, "", "en", "s", 0), (None, one["text"], "en", "s", 1), (9_000_003, " the and of \n", None, None, 5)]
    docs = start.union(start.limit(5)).union(spark.createDataFrame(odd, start.schema))
    clash = {"id": 1, "row": "r", "lang_pred": "x", "sid": 2, "keep_id": 3, "digest": "d", "block": 4, "language": 5}
    docs = docs.withColumns({k: F.lit(v) for k, v in clash.items()})
    names = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        after.append(docs)
    known, once, alone, mixed, tokens = after
    assert all(d.columns == names for d in after[:4])
    ids = {r["doc_id"] for r in known.collect()}
    assert 9_000_001 not in ids and 9_000_002 not in ids and 9_000_000 in ids
    texts = [r["text"] for r in once.collect()]
    assert len(texts) == len(set(texts))
    kept = {r["doc_id"]: r["text"] for r in alone.collect()}
    assert kept[9_000_000] == long and set(kept.values()) <= set(texts)
    assert {(r["id"], r["row"], r["block"]) for r in mixed.collect()} == {(1, "r", 4)}
    assert tokens.count() == mixed.count() > 0
