"""Text operators against brute force, round trips and held-out accuracy, with edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import ann, bpe, chat, exact_dedup, jaccard, langid, license_scan, mixing, queries, secret_scan, shingles, token_counts, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = {i: i + 32 for i in range(65, 91)}


def docs_of(spark, texts, start=0):
    rows = [(start + k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    assert ordered(df.select(cols).collect()) == ordered(db.execute("SELECT " + ", ".join(cols) + f" FROM ({queries.ORACLES[name]})").fetchall())


# --- language ID


def test_language_is_told_on_held_out_rows(spark, sf_dir, db):
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op1_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = docs_of(spark, [None, "", "1234 !!! ...", "the and of is this", "the and of is this", "der die das und ist " * 100_000, "漢字仮名"])
    got = {r["doc_id"]: r for r in langid.predict(df, model).select("doc_id", "language.*").collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and all(got[k]["rejected"] for k in range(3))
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "en" and got[5]["lang_pred"] == "de" and got[6]["rejected"]
    empty = langid.fit(df.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(df, empty).select("language.lang_pred").collect()} == {"und"}
    clash = df.withColumn("score", F.lit(1)).withColumn("language", F.lit("x"))
    assert langid.accepted(clash).columns == clash.columns
    assert langid.accepted(df.limit(0)).count() == 0


def test_the_nearest_centroid_wins(spark, sf_dir):
    """The query's rule, text by text with dictionaries: counts, weights, cosine, least distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 3 > 0"), per_lang=30, clusters=2)
    for r in langid.predict(docs.select("doc_id", "text"), model).limit(60).collect():
        low = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        c = [32, *map(ord, " ".join(low.split())), 32]
        grams = collections.Counter()
        for a, b in zip(c, c[1:], strict=False):
            grams[((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF)) >> 20] += 1
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            pair = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF)
            grams[((pair * 0xC2B2AE3D & 0xFFFFFFFF) ^ (d * 0x27D4EB2F & 0xFFFFFFFF)) >> 20] += 1
        v = {g: np.log1p(n) * float(model.idf[g]) for g, n in grams.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x * float(m[g]) for g, x in v.items()) / size for m in model.centroids] if low.strip() else []
        got = r["language"]
        if not cos:
            assert got["lang_pred"] == "und" and got["score"] == 0
        else:
            assert got["score"] == pytest.approx(max(0, max(cos)), abs=1e-5)
            assert max(x for x, lang in zip(cos, model.langs, strict=True) if lang == got["lang_pred"]) == pytest.approx(max(cos), abs=1e-5)


def test_pieces_of_a_text_leave_no_seam(monkeypatch):
    text = "Der Hund, die Katze -- 12 ... und \n" * 40 + "ΑΣ " * 7
    whole = langid.gram_counts(text)
    for piece in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.gram_counts(text) == whole).all()
    assert langid.gram_counts("1 2 3") is None and langid.gram_counts("") is None and langid.gram_counts(None) is None


def test_labels_are_bounded(spark):
    rows = [(f"l{k:02}", f"{chr(97 + k)}{chr(98 + k)} word{j}") for k in range(20) for j in range(1 + k)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), max_langs=5, sample_rows=10)
    assert sorted(set(model.langs)) == ["l15", "l16", "l17", "l18", "l19"]


def test_copies_leave_a_language_its_sample(spark):
    copies = spark.range(20_000).select(F.lit("xx").alias("lang"), F.lit("zzot qirr vex olluk zzot").alias("text"))
    words = [(lang, f"{a} {b} {a}{b} {c}") for lang, v in (("xx", ("zzot", "qirr", "vex", "olluk")), ("en", ("the", "and", "house", "water"))) for a in v for b in v for c in v]
    blank = spark.range(20_000).select(F.lit("xx").alias("lang"), F.concat(F.lit("-- "), F.col("id").cast("string")).alias("text"))
    rows = copies.union(blank).union(spark.createDataFrame(words, "lang string, text string"))
    model = langid.fit(rows)
    assert model.langs == ["en"] * 4 + ["xx"] * 4
    said = langid.predict(spark.createDataFrame(words, "lang string, text string"), model).select("lang", "language.*").collect()
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in said)


# --- encoding


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary())


def hard_texts():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rng.choice(letters if rng.random() < 0.8 else "aeiouth'1é ß<|>.-_Σİ\n\t 漢😀") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    return [*made, *("a" * k for k in range(1, 120)), "ab" * 300, "<|endoftext|>hi<|startoftext|> <|x|>", "ΑΣ ΣΑΣ", "é É é", "", "  ", "don't we'LL I'd 's", "x" * 5000]


def test_encoding_is_the_library_s(library):
    texts = hard_texts()
    model = bpe.Bpe(queries.vocabulary())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert model.encode_batch(texts) == want
    assert [model.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert model.encode_batch([None]) == [[]] and model.decode(None) == ""


def test_letters_of_newer_unicode_are_the_library_s(library):
    points = [c for first, last in (*words.NEWER_LETTERS, *words.NEWER_NUMBERS) for c in (first - 1, first, last, last + 1)]
    points += [c for first, last, _ in words.NEWER_CAPITALS for c in (first, last)]
    texts = [f"b{chr(c)}.{chr(c)}7{chr(c)}" for c in points]
    assert bpe.Bpe(queries.vocabulary()).encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_speculation_and_exact_merging_agree():
    model = bpe.Bpe(queries.vocabulary())
    found = {w for t in hard_texts() for w in words.words(t) if w not in words.SPECIAL}
    model.solve(sorted(found))
    right = sum(model.greedy(words.letters(w)) == list(model.solved[w]) for w in found)
    assert all(model.exact(words.letters(w)) == list(model.solved[w]) for w in found) and 0 < right < len(found)


def test_encode_and_decode_frames(spark, sf_dir, library, texts):
    path = queries.vocabulary()
    df = docs_of(spark, ["Hello, world!", None, "", "Hello, world!"]).withColumn("ids", F.lit("clash"))
    twice = bpe.decode(bpe.encode(df.drop("ids"), path), path).select("doc_id", "ids", "decoded").collect()
    assert ordered(bpe.round_trip(df, path).select("doc_id", "ids", "decoded").collect()) == ordered(twice)
    assert [r["ids"] for r in sorted(twice)][1:3] == [[], []]
    assert bpe.round_trip(df.limit(0), path).count() == 0
    for r in queries.op2_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- nearest vectors


def test_nearest_vectors_reach_recall(spark, sf_dir, db):
    rows = db.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = collections.defaultdict(list)
    for r in queries.op3_nearest_vectors(spark, sf_dir).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asks, hits = np.flatnonzero(ids % 100 == 0), 0
    for i in asks:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert all(abs(d[np.flatnonzero(ids == m[1])[0]] - m[2]) < 1e-12 for m in mine)
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & {m[1] for m in mine})
    assert hits >= 0.9 * 10 * len(asks)


def test_nearest_vectors_edge_cases(spark):
    rows = [(k, [1.0, float(k // 5)]) for k in range(40)]
    rows += [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [1.0, float("nan")]), (104, [1.0, 2.0, 3.0]), (105, []), (200, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2.0))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 200}
    assert [v for _, v, _ in sorted(got[0])] == [1, 2, 3, 4, 5, 6, 7]
    assert [(v, s) for _, v, s in sorted(got[200])] == [(15, 0.0), (16, 0.0), (17, 0.0), (18, 0.0), (19, 0.0), (10, 1.0), (11, 1.0)]
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0


def test_nearest_vectors_beyond_the_range_of_squares(spark):
    for size in (1e160, 1e-200, 1.7e308):
        rows = [(k, [size * (1 - k / 64), size / 2]) for k in range(20)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [1, 2, 3]
        assert [r["score"] for r in got] == pytest.approx([size * (k / 64) for k in (1, 2, 3)])


def test_nearest_vectors_of_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 9.0]), (2, [1.0, 4.0]), (3, [1.0, 6.0]), (4, [1.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 3.0), (0, 3, 3, 5.0)]


def test_nearest_vectors_in_blocks_and_slices(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 3 == 0, k=5, leaf=4, recall=1.0, part_rows=20, query_rows=16, tuning=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    hits = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len({v for _, v in near} & set(np.argsort(d)[:5]))
    assert len(got) == 300 and hits >= 0.95 * 1500
    points = df.select(F.col("vec_id").alias("p"), F.col("embedding").alias("x"))
    asks = df.where("vec_id < 40").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    best = collections.defaultdict(list)
    for r in ann._in_blocks(asks, points, 3, 8, 50).collect():
        best[r["q"]].append((r["distance"], r["p"]))
    for q, near in best.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [p for _, p in sorted(near)[:4]] == np.argsort(d, kind="stable")[:4].tolist()
    assert len(best) == 40


# --- chat


def test_a_null_turn_comes_first_in_query_and_sql(spark, tmp_path):
    rows = [(1, None, "user", "a"), (1, 0, "assistant", "b"), (2, 1, "assistant", "c"), (2, None, "assistant", "[d]"), (2, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = queries.op4_chat_format(spark, str(tmp_path))
    said = ordered(df.select(sorted(df.columns)).collect())
    assert said == ordered(con.execute("SELECT " + ", ".join(sorted(df.columns)) + f" FROM ({queries.OP4})").fetchall())
    assert {r["conv_id"]: r["formatted_chars"] for r in df.collect()}[1] == 37


def test_chat_is_read_back(spark):
    odd = ["[[user]]\n&amp;[[/]]\n", "&lb;", "", None, "a]]\nb", "&&[["]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(4) for t, role in enumerate(["system", "user", "assistant", "we]]\n[ird&", "assistant", "user"][: 3 + c])]
    rows += [(9, None, None, None), (9, 1, "assistant", "x"), (9, 1, "assistant", "x"), (None, 0, "assistant", "null conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("examples", F.lit(1))
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0, role or "", text or ""), (role or "", text or "")))
    back = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    assert set(back) == set(by)
    for c, turns in by.items():
        want = [x for _, x in sorted(turns)]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert "".join(back[c]["losses"]) == "".join(t for role, t in want if role == "assistant")
    # of one turn, rows go by raw role and text: "A" before "[" before "b"
    tie = spark.createDataFrame([(1, 0, "user", t) for t in ("b", "[", "A", "&")], "conv_id long, turn long, role string, text string")
    assert [t["text"] for t in chat.read_back(chat.examples(tie)).first()["turns"]] == ["&", "A", "[", "b"]
    compact = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    made = collections.defaultdict(list)
    for e in chat.examples(df).orderBy("example").collect():
        made[e["conv_id"]].append(e)
    for c, r in compact.items():
        assert [(e["text"], e["loss_start"], e["loss_chars"]) for e in made[c]] == [(r["text"][: x["end"]], x["loss_start"], x["loss_chars"]) for x in r["examples"]]
        assert made[c][-1]["text"] == r["text"] and sum(len(e["text"]) for e in made[c]) == back[c]["formatted_chars"]
    each = chat.examples(df).where("conv_id = 3").orderBy("example").collect()
    assert len(each) == 3 and each[1]["text"].startswith(each[0]["text"]) and each[2]["loss_chars"] == 0
    assert all(e["text"][e["loss_start"] - 1 :][: e["loss_chars"] + 6].endswith("[[/]]\n") for e in each[:2])
    assert chat.formatted(df.limit(0)).count() == 0


# --- licenses


def test_license_places(spark, sf_dir, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in queries.op5_license_scan(spark, sf_dir).collect():
        w = word.findall((texts[r["doc_id"]] or "").translate(LOW))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_templates(spark):
    long = "wörd " * 300_000
    texts = [
        "Copyright 2020 by Some One. All rights reserved.", "Copyright " + "x " * 9 + "all rights reserved", "Licensed under the GNU General Public License v3", "licensed under the GNU Lesser General Public License",
        long + "MIT License " + long + "cc by", None, "", "cc by cc by",
    ]
    got = {r["doc_id"]: r for r in license_scan.license_places(docs_of(spark, texts).withColumn("places", F.lit(0))).collect()}
    labels = [sorted({p["label"] for p in got[k]["places"]}) for k in range(len(texts))]
    assert labels == [["all-rights-reserved"], [], ["gpl", "gpl-notice"], [], ["cc-by", "mit"], [], [], ["cc-by"]]
    assert [(p["start"], p["stop"]) for p in got[4]["places"]] == [(300_000, 300_002), (600_002, 600_004)]
    assert [(p["start"], p["stop"]) for p in got[2]["places"]] == [(0, 8), (3, 7)] or sorted((p["start"], p["stop"]) for p in got[2]["places"]) == [(0, 8), (3, 7)]
    assert got[5]["n_words"] == 0 and got[7]["n_words"] == 4
    assert license_scan.license_places(docs_of(spark, texts).limit(0)).count() == 0


def test_full_licenses_are_told(spark):
    strip = lambda t: re.sub(r"<<any \d+>>", "x", re.sub(r"<</?optional>>", "", t))
    made = [(label, strip(t)) for t, label in license_scan.TEMPLATES.items()]
    rows = license_scan.license_places(docs_of(spark, [f"Some words. {t}. More words" for _, t in made])).collect()
    assert all(label in {p["label"] for p in r["places"]} for (label, _), r in zip(made, sorted(rows), strict=True))
    full = dict((label, t) for t, label in license_scan.TEMPLATES.items())
    left_out = re.sub(r"<<optional>>.*?<</optional>>", "", full["mit-full"]).replace("<<any 12>>", "")
    wrong = left_out.replace("merchantability", "merchantableness")
    auto = license_scan.compiled({}, {full["mit-full"]: "mit-full"})
    assert [[p[0] for p in license_scan.scan(t, auto)[1]] for t in (left_out, wrong, left_out + " x", left_out[:-9])] == [["mit-full"], [], ["mit-full"], []]
    assert license_scan.scan("Any tool at all is free software " + "x", license_scan.compiled({}, {"<<any 3>> is free software": "free"}))[1] == [("free", False, 4, 7, 3)]


# --- exact copies


def test_exact_dedup_edge_cases(spark):
    texts = ["a", "a", None, "", "b", "a ", "A"] + ["hot"] * 50
    df = docs_of(spark, texts).union(docs_of(spark, ["b"], 4)).union(spark.createDataFrame([(None, "hot", None, None, None)], DOCS)).withColumn("kept", F.lit("x"))
    got = exact_dedup.exact_dedup(df, tracked=8).collect()
    assert len(got) == df.count()
    size = collections.Counter(t or "" for t in [*texts, "b", "hot"])
    best = {}
    for k, t in [*enumerate(texts), (4, "b")]:
        best[t or ""] = max(k, best.get(t or "", -1))
    named = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    kept = collections.Counter()
    for r in got:
        t = named[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (best[t], size[t])
        kept[t] += r["kept"]
        assert not r["kept"] or r["doc_id"] == best[t]
    assert set(kept.values()) == {1}
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and ordered(left.select("doc_id").collect()) == ordered((k,) for k in best.values())
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_takes_any_column_names(spark):
    names = ["id", "digest", "row", "_id", "_digest", "again", "heavy_keep"]
    df = docs_of(spark, ["a", "a", None, "", "b"]).union(docs_of(spark, ["b"], 4)).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and ordered(left.select("doc_id", *names).collect()) == ordered((i, *range(len(names))) for i in (1, 3, 4))


# --- mixing


def plain_targets(sizes, weights, share, most):
    """Words of each source by weight; those that would be more than full are, and the rest is dealt again."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    full = set()
    while True:
        level = (share * sum(sizes) - sum(most * sizes[k] for k in full)) / max(1, sum(w for k, w in enumerate(weight) if k not in full))
        over = {k for k, n in enumerate(sizes) if k not in full and level * weight[k] > most * n}
        if not over:
            return [most * n if k in full else level * weight[k] for k, n in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [0, 10], [5, 1000, 3, 70], [0, 0], [7]])
def test_targets_are_filled_by_weight(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "s long, source_size long")
    got = [r["target"] for r in mixing.with_targets(df, (5, 2, 1), 1.5, 2.0).orderBy("s").collect()]
    assert got == pytest.approx(plain_targets(sizes, (5, 2, 1), 1.5, 2.0)) and sum(got) == pytest.approx(1.5 * sum(sizes))
    assert sizes != [100, 100, 100] or got == pytest.approx([200, 500 / 3, 250 / 3])


def test_permutations_are_such_and_look_random(spark):
    n = F.lit(1000).cast("long")
    rows = spark.range(1000).select([mixing.permuted(F.col("id"), n, F.lit(17), F.lit(p)).alias(f"p{p}") for p in range(2)]).collect()
    for k in range(2):
        p = [r[k] for r in rows]
        assert sorted(p) == list(range(1000))
        # neighbours lie neither side by side nor at one distance
        steps = collections.Counter((b - a) % 1000 for a, b in zip(p, p[1:], strict=False))
        assert max(steps.values()) < 12 and abs(np.corrcoef(range(1000), p)[0, 1]) < 0.15
    assert sum(a == b for a, b in rows) < 12
    for size in (1, 2, 3, 7):
        got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(size))


def test_mixture(spark, sf_dir, db):
    rows = queries.op7_mix_sources(spark, sf_dir).collect()
    assert ordered(rows) == ordered(queries.op7_mix_sources(spark, sf_dir).collect())
    source = dict(db.execute("SELECT doc_id, source FROM documents").fetchall())
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    total, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        total[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert len(rows) == len(size) and all(r["source_size"] == total[source[r["doc_id"]]] for r in rows)
    want = plain_targets([total[s] for s in sorted(total)], (5, 2, 1), 1.5, 2.0)
    assert [target[s] for s in sorted(total)] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 2 * 64 for s in total)


def test_mixed_documents_hold_what_is_taken(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None, "", " \n ", "one", "one"]
    df = docs_of(spark, texts).union(docs_of(spark, ["one"], len(texts) - 1)).withColumn("taken", F.lit(5)).withColumn("size", F.lit("x"))
    mixed = mixing.mixed_documents(df, block=16)
    assert mixed.columns == df.columns
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    want = {r["doc_id"]: r["n"] for r in mixing.mixture(df, block=16).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert {k: n for k, n in want.items() if n} == got
    assert mixed.where("length(text) <> n_chars").count() == 0
    assert mixing.mixture(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_the_mix_is_that_of_reading_its_slots(spark, sf_dir):
    """Word by word: each source's stream, cut into blocks; each slot reads one."""
    block = 16
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = mixing.mix(docs, block=block)
    stream, owner = collections.defaultdict(dict), collections.Counter()
    for r in m.rows.collect():
        for k in range(r["size"]):
            assert stream[r["s"]].setdefault(r["offset"] + k, r["id"]) == r["id"]
    assert all(sorted(v) == list(range(len(v))) for v in stream.values())
    slots = [tuple(r) for r in m.slots.select("s", "block", "pass").collect()]
    assert len(set(slots)) == len(slots)
    plan = {r["s"]: r for r in m.sources.collect()}
    assert collections.Counter(s for s, _, _ in slots) == {s: r["quota"] for s, r in plan.items() if r["quota"]}
    for s, b, _ in slots:
        for at in range(b * block, min((b + 1) * block, len(stream[s]))):
            owner[stream[s][at]] += 1
    got = {r["doc_id"]: r["taken"] for r in mixing.mixture(docs, block=block).collect()}
    assert got == {r["id"]: owner[r["id"]] for r in m.rows.select("id").collect()}


def test_shards_draw_their_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 100)
    monkeypatch.setattr(mixing, "CELLS", 8)
    df = docs_of(spark, [" ".join(["w"] * n) for n in (5000, 3000, 700, 40, 2500)])
    m = mixing.mix(df, block=4)
    counts = collections.defaultdict(collections.Counter)
    for r in m.slots.collect():
        counts[r["shard"]][r["s"]] += 1
    total = sum(sum(c.values()) for c in counts.values())
    assert all(sum(c.values()) == min(100, total - 100 * k) for k, c in counts.items())
    largest = max(m.sources.collect(), key=lambda r: r["quota"])["s"]
    assert len({c[largest] for c in counts.values()}) > 5  # counts vary like draws do


def test_mixing_takes_any_column_names_and_repeated_rows(spark):
    names = ["id", "hash", "copy", "s", "offset", "size", "parts", "row", "words", "take", "_hash", "bucket", "block", "pass"]
    df = docs_of(spark, ["a b c d e f g h", "a b c d e f g h", None, "", "x " * 5000]).union(docs_of(spark, ["a b c d e f g h"], 1))
    df = df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = mixing.mixed_documents(df, block=4)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = out.collect()
    assert rows and all(r[n] == k for r in rows for k, n in enumerate(names))
    assert ordered(rows) == ordered(mixing.mixed_documents(df, block=4).collect())


def test_passes_permute_blocks(spark):
    df = docs_of(spark, [" ".join(["w"] * n) for n in (5000, 3000, 700, 40)])
    m = mixing.mix(df, block=8)
    seen = m.slots.groupBy("s", "block", "pass").count()
    assert seen.where("count > 1").count() == 0
    first = {r["s"]: r["n"] for r in m.slots.where("pass = 0").groupBy("s").agg(F.countDistinct("block").alias("n")).collect()}
    more = {r["s"] for r in m.slots.where("pass = 1").select("s").distinct().collect()}
    blocks = {r["s"]: -(-r["n"] // 8) for r in m.rows.groupBy("s").agg(F.sum("size").alias("n")).collect()}
    assert all(first[s] == blocks[s] for s in more)


# --- secrets

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    out = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= least]
    return ",".join(x for _, _, x in sorted(out))


def test_secret_edge_cases(spark):
    texts = [
        "password: token = abcdefgh", "token=secret=abcdef", "PassWord='hunter22' api_key:abc123 apikey = \"abcdef\"", "AKIA" + "A" * 16 + " AKIA123 AKIAAKIA" + "B" * 12, "0" * 23 + "g" + "f" * 24, "é😀 secret=ümlaut secret=abcdefg",
        None, "", "ghp_" + "Z" * 36 + " xoxb-1234567890 -----BEGIN RSA PRIVATE KEY-----", "token=" + "x" * 300_000, "token" * 1000 + "=abcdef",
    ]
    df = docs_of(spark, texts).union(docs_of(spark, ["secret = 123456"], 0)).withColumn("spans", F.lit(1)).withColumn("key", F.lit(2))
    rows = secret_scan.secret_spans(df).select("doc_id", secret_scan.named(F.filter("spans", lambda s: s["order"] < 3)).alias("base"), secret_scan.named(F.col("spans")).alias("all")).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["base"])
    assert len(rows) == len(texts) + 1
    assert got[0] == {base_spans(texts[0]), "assign:0:15"}
    assert all(got[k] == {base_spans(t or "")} for k, t in enumerate(texts) if k)
    extra = next(r["all"] for r in rows if r["doc_id"] == 8)
    assert [x.split(":")[0] for x in extra.split(",")] == ["git_token", "chat_token", "private_key"]
    assert secret_scan.secret_spans(df.limit(0)).count() == 0


def test_trigram_queries_are_necessary():
    for rule in secret_scan.RULES:
        clauses = secret_scan.trigram_query(rule.pattern)
        for text in ("passwd: xx", "API_KEY=1", "apikey=1", "AKIAB", "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----"):
            if re.search(rule.pattern, text, re.A):
                assert any(all(t in text.lower() for t in c) for c in clauses)
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") == [frozenset()]
    assert secret_scan.trigram_query("x[ab]yz") == [frozenset({"xay", "ayz"}), frozenset({"xby", "byz"})]
    assert [r.kind for r in secret_scan.RULES if not all(secret_scan.trigram_query(r.pattern))] == ["hex"]


def test_posting_lists_are_intersected(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    texts = ["Password", "pass word", "secret token", "AKIA", "aki kia", "", None, "sec cre ecr ret", "xpassx asswx sswox swor word"] * 3
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    queries_ = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES if r.kind in ("assign", "access")}
    got = {r["key"]: set(r["kinds"]) for r in secret_scan.candidates(rows, queries_).collect()}
    want = {k: {kind for kind, clauses in queries_.items() if any(all(t in (text or "").lower() for t in c) for c in clauses)} for k, text in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v} and got[0] == {"assign"} and got[4] == {"access"}
    wanted = {t for c in queries_.values() for x in c for t in x}
    index = secret_scan.postings(rows, sorted(wanted)).collect()
    assert len(index) > 3 and {(t, k) for r in index for t, keys in r["lists"].items() for k in keys} == {(t, k) for k, text in enumerate(texts) for t in wanted if t in (text or "").lower()}


# --- counts


def test_counts_equal_pieces_that_are_built(spark, sf_dir, texts):
    model = bpe.Bpe(queries.vocabulary())
    auto = token_counts.Automaton(queries.vocabulary())
    found = {w for t in [*hard_texts(), *texts.values()] for w in words.words(t) if w not in words.SPECIAL}
    assert all(auto.count(w) == len(model.greedy(words.letters(w))) for w in found)
    for r in queries.op9_token_counts(spark, sf_dir).collect():
        n = [1 if w in words.SPECIAL else len(model.greedy(words.letters(w))) for w in words.words(texts[r["doc_id"]])]
        assert tuple(r)[1:] == (len(n), sum(n), max(n, default=0))
    df = docs_of(spark, [None, "", "Hello hello <|endoftext|>", "Hello hello <|endoftext|>", "ab" * 200_000]).withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(df, queries.vocabulary()).collect()}
    assert got[0] == got[1] == (0, 0, 0) and got[2] == got[3] and got[2][0] == 3 and got[4][0] == 1
    assert token_counts.token_counts(df.limit(0), queries.vocabulary()).count() == 0


# --- near copies


def brute_groups(rows, k, num, den):
    """n_shingles and component of every row, by comparing all pairs."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[top(a)] = min(i, least.get(top(a), i))
    return sorted((i, len(sets[a]), least[top(a)]) for a, (i, _) in enumerate(rows))


def near_copies():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocab, k=60)
    out = [None, "", "  ", "one", "One", "one two", "one two three", "one two three"]
    for n in (8, 9, 10, 11, 15, 19, 20, 21, 29, 30, 40, 90, 150, 400):
        base = rng.choices(vocab, k=n)
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 6):
            t = base[:]
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[:-1] if rng.random() < 0.5 else [*t, "tail"]
            out.append(" ".join(t))
    out += [" ".join([*rng.choices(vocab, k=rng.randint(10, 60)), *passage]) for _ in range(40)]
    hot = rng.choices(vocab, k=120)
    for _ in range(80):
        t = hot[:]
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(120)] = rng.choice(vocab)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_groups_equal_brute_force(spark, k, num, den):
    texts = near_copies()
    rows = list(enumerate(texts))
    df = docs_of(spark, texts).withColumn("sid", F.lit("clash")).withColumn("n", F.lit(1))
    got = jaccard.jaccard_groups(df, k, num, den)
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, k, num, den)


def test_boundary_does_not_change_groups(spark, monkeypatch):
    texts = near_copies()
    df, want = docs_of(spark, texts), brute_groups(list(enumerate(texts)), 3, 90, 100)
    for limit in (10, 30):
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, num, den, limit=limit: limit)
        assert sorted(map(tuple, jaccard.jaccard_groups(df, 3, 90, 100).collect())) == want
    monkeypatch.setattr(jaccard, "SPLIT_CLASS", 3)
    assert sorted(map(tuple, jaccard.jaccard_groups(df, 3, 90, 100).collect())) == want
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 5)
    assert sorted(map(tuple, jaccard.jaccard_groups(df, 3, 90, 100).collect())) == want


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """First hashes of 4 bits: nearly every name is shared by several sets."""
    texts = near_copies()
    df, want = docs_of(spark, texts), brute_groups(list(enumerate(texts)), 3, 90, 100)
    twin = jaccard._twin

    def weak(s):
        return int(s[0] % np.uint64(16)) if len(s) else 0

    def named(s, names):
        return names.get((weak(s), twin(s)), weak(s)) if names else weak(s)

    monkeypatch.setattr(jaccard, "_sid", weak)
    monkeypatch.setattr(jaccard, "_named", named)
    assert sorted(map(tuple, jaccard.jaccard_groups(df, 3, 90, 100).collect())) == want
    again = df.union(df.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("other words before "), "text")))
    left = jaccard.drop_near_copies(again)
    monkeypatch.undo()
    assert ordered(left.collect()) == ordered(jaccard.drop_near_copies(again).collect())


def test_jaccard_query_is_brute_force(spark, sf_dir, texts):
    got = sorted(map(tuple, queries.op10_jaccard_join(spark, sf_dir).collect()))
    assert got == brute_groups(sorted(texts.items()), 3, 90, 100)


def test_near_copies_go_once(spark):
    df = docs_of(spark, ["a b c d e f g"] * 3 + ["other words are here now", None, None])
    left = jaccard.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 3, 4, 5]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "x y")], "doc_id long, text string")
    assert ordered(jaccard.jaccard_groups(nulls).collect()) == ordered([(None, 1, None), (1, 1, 1), (1, 1, 1), (2, 1, 2)])


def test_near_copies_take_any_column_names(spark):
    names = ["id", "sid", "row", "_id", "_digest", "digest", "component_id", "kept"]
    df = docs_of(spark, ["a b c d e f g"] * 3 + ["other words are here now"]).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for rows in (df, df.union(df.where("doc_id = 3"))):
        left = jaccard.drop_near_copies(rows)
        assert left.columns == df.columns and ordered(left.select("doc_id", *names).collect()) == ordered((i, *range(len(names))) for i in (0, 3))


def test_near_copies_of_repeated_ids_go_by_row(spark):
    near, other = "a b c d e f g", "other words are here now then"
    rows = [(3, near), (5, near), (5, other), (1, "p q r s t u"), (1, "P q r s t u"), (1, "P q r s t u"), (2, "p q r s t u"), (6, "x"), (6, "x"), (None, near), (7, None), (7, other.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = jaccard.drop_near_copies(df)
    assert left.columns == df.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in left.collect())
    assert got == sorted([(0, near), (1, "p q r s t u"), (3, near), (5, other), (6, "x"), (7, "")])


def test_words_of_any_length_are_read_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    many = ["".join(rng.choice(["a", "B", " ", "é", "\n", "xyz", "  "]) for _ in range(rng.randrange(0, 400))) for _ in range(200)]
    many += [None, "", " ", "x" * 500, "x" * 64 + " ", "a " * 200, "p " + "é" * 300 + " q"]
    want = list(shingles.shingle_sets(pa.array(many), 3))
    for piece in (16, 64, 100, 1000):
        monkeypatch.setattr(shingles, "PIECE", piece)
        shingles._powers.clear()
        assert all(np.array_equal(a, b) for a, b in zip(want, shingles.shingle_sets(pa.array(many), 3), strict=True))
    shingles._powers.clear()


def test_a_text_without_white_space_needs_little_memory():
    """256 MB as one word: the process stays below 200 MB beyond the text that it is given and the copy that makes it."""
    import subprocess
    import sys

    code = """
import resource
import pyarrow as pa
from skyloom.llm import shingles
text = pa.array(["z" * (256 << 20)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(s,) = shingles.shingle_sets(text, 3)
print(len(s), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    n, more = map(int, said.stdout.split())
    assert n == 1 and more < 200 << 10


def test_long_texts_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{k % 977}é" for k in range(20_000))
    whole = next(iter(shingles.shingle_sets(pa.array([text]), 3)))
    monkeypatch.setattr(shingles, "PIECE", 1000)
    parts = list(shingles.shingle_sets(pa.array(["a b c", text, None, "A b C"]), 3))
    assert (parts[1] == whole).all() and len(parts[2]) == 0 and (parts[0] == parts[3]).all() and len(whole) == 977
