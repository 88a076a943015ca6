"""Fill-in-the-middle, fingerprints and whitening against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import fim, queries, simhash, whitening

DOCS = "doc_id long, text string"


# --- fill-in-the-middle


@pytest.mark.parametrize("unit", ["char", "word"])
def test_cuts_are_those_of_a_plain_search(unit, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 16)
    monkeypatch.setattr(fim, "STEP", 64)
    rng = random.Random(4)
    for size in (1, 3, 15, 16, 17, 64, 65, 300, 1000):
        text = "".join(rng.choice(["a", "é", "漢", "🙂", " ", "\n", "bc"]) for _ in range(size))
        cuts = fim.Cuts(text.encode(), unit)
        ends = list(range(len(text) + 1))
        if unit == "word":
            starts = [k for k, c in enumerate(text) if c not in " \t\n\v\f\r" and (k == 0 or text[k - 1] in " \t\n\v\f\r")]
            ends = [0, *starts[1:], len(text)] if starts else [0]
        assert cuts.units == len(ends) - 1 and cuts.points == len(text)
        for k, chars in enumerate(ends):
            assert cuts.after(k) == (len(text[:chars].encode()), chars)


def test_examples_are_rebuilt_and_edge_cases_stay_plain(spark):
    texts = [None, "", "x", "ab<P>cd", "<", "a<S", "é漢🙂" * 5, "S><M" * 9, "word " * 400_000, "🙂" * 300_000] + ["some words to be cut"] * 300
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id"), (6, "again")], DOCS).withColumns({"form": F.lit(1), "n": F.lit(2), "output": F.lit(3), "id": F.lit(4), "name": F.lit(5)})
    made = fim.fill_in_middle(df)
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 2
    said = {"plain": 0, "psm": 0, "spm": 0}
    for r in rows:
        text = "null id" if r["doc_id"] is None else "again" if r["back"] == "again" else texts[r["doc_id"]] or ""
        assert r["back"] == text and r["n"] == len(text)
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        h = [int(hashlib.sha256(f"1:{name}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
        said[r["form"]] += 1
        if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
            assert r["form"] == "plain" and r["output"] == text and r["prefix_chars"] is None and r["middle_chars"] is None
            continue
        a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
        assert (r["prefix_chars"], r["middle_chars"]) == (a, b - a)
        one = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if h[3] % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
        assert r["output"] == one
    assert min(said.values()) > 10
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(df, unit="line")


def test_rates_and_words(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    assert {r["form"] for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(df, rate=100, spm=100).collect()} == {"spm"}
    words = fim.fill_in_middle(df, rate=100, unit="word").collect()
    assert {r["n"] for r in words} == {4} and {r["prefix_chars"] for r in words} == {0, 4, 8, 14, 18}


# --- fingerprints


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    width = min(k, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[j : j + width]).encode(), seed=42) for j in range(len(words) - width + 1)] if words else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(fps, distance):
    """Least index of each one's component, all pairs compared."""
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= distance).tolist():
            x, y = sorted((find(i), find(j)))
            top[y] = x
    return [find(x) for x in range(len(fps))]


def test_simhash_query_is_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op13_simhash(spark, sf_dir).collect()}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i in ids] == [ids[c] for c in plain_components(fps, 3)]
    # JVM and library hash alike
    assert spark.sql("SELECT xxhash64('a b c') AS h").first()["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def groups_of(spark, fps, distance, monkeypatch=None):
    """Components of given fingerprints, by the operator's own search."""
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in dict.fromkeys(signed)], "fp long")
    groups = simhash.grouped_bits(simhash.agreement(df))
    v = simhash.values(np.array(fps, np.uint64), groups)
    histogram = np.stack([np.bincount(x, minlength=1 << simhash.WIDTH) for x in v])
    edges = simhash.links(simhash.entries(df, groups, histogram, distance), distance).collect()
    at = {f: k for k, f in enumerate(signed)}
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in edges:
        x, y = sorted((find(at[r["a"]]), find(at[r["b"]])))
        top[y] = x
    return [find(x) for x in range(len(fps))], len(edges)


@pytest.mark.parametrize(("distance", "block", "held"), [(0, 1 << 15, 1 << 17), (1, 8, 64), (2, 64, 1 << 17), (3, 1 << 15, 1 << 17), (3, 32, 128), (5, 1 << 15, 1 << 17)])
def test_every_link_is_found(spark, monkeypatch, distance, block, held):
    """Clusters around centres that share two parts, so that some parts are frequent; small blocks and held rows as well."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "STEP", 50 if held < 1000 else 1 << 16)
    rng = random.Random(distance * 7 + block)
    fps = [0]
    for c in range(12):
        centre = rng.getrandbits(32) if c % 2 else rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    got, edges = groups_of(spark, fps, distance)
    assert got == plain_components(fps, distance)


def test_a_dense_group_makes_few_edges(spark):
    """1,500 fingerprints around one: all parts are frequent, and edges stay in proportion to the members."""
    rng = random.Random(5)
    fps = {0xDEADBEEF12345678}
    while len(fps) < 1500:
        x = 0xDEADBEEF12345678
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    got, edges = groups_of(spark, fps, 3)
    assert got == plain_components(fps, 3)
    assert edges < 40 * len(fps)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(3)
    histogram = rng.integers(0, 40, (4, 1 << simhash.WIDTH))
    histogram[0, :300] = 100_000
    near = np.stack([simhash.within(h, 3) for h in histogram])
    v = rng.integers(0, 400, (4, 50))
    t = simhash.thresholds(v, near, 0)
    balls = [1, 17, 137, 697]
    cost = lambda p, r, x: 0 if r < 0 else simhash.PROBE_COST * balls[r] + near[p, r, x]
    ways = [(a, b, c, -a - b - c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if -1 <= -a - b - c <= 3]
    for k in range(50):
        best = min(sum(cost(p, r, v[p, k]) for p, r in enumerate(w)) for w in ways)
        assert sum(t[:, k]) == 0 and np.isclose(sum(cost(p, int(t[p, k]), v[p, k]) for p in range(4)), best)
    # exact counts of neighbours
    x = 1234
    assert near[1, 2, x] == sum(histogram[1, y] for y in range(1 << 16) if (x ^ y).bit_count() <= 2)


def test_fingerprint_edge_cases(spark, monkeypatch):
    long = "The Quick\tbrown fox " * 50_000
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e f", "a b c d e f", long, long.lower(), "é漢 Ω x y z É", "x" * 3_000_000, "x" * 3_000_000 + " y", "p q r " + "Y" * 2_500_000 + " s t u"]
    df = spark.createDataFrame([*enumerate(texts), (None, "one"), (3, "zwei"), (7, None)], DOCS).withColumns({"fp": F.lit(1), "id": F.lit(4), "fingerprint": F.lit(5), "component_id": F.lit(0), "least": F.lit(3)})
    rows = simhash.simhash_groups(df, k=3).collect()
    assert len(rows) == len(texts) + 3
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts):
        assert f"{plain_fingerprint(t):016x}" in {r["fingerprint"] for r in by_id[k]}
    for k in (0, 1, 2):
        assert (by_id[k][0]["fingerprint"], by_id[k][0]["component_id"]) == ("0" * 16, 0)
    assert by_id[4][0]["component_id"] == 3 and by_id[9][0]["component_id"] == 8
    assert by_id[None][0]["component_id"] is None and by_id[None][0]["fingerprint"] == by_id[4][0]["fingerprint"]
    assert {(r["fingerprint"], r["component_id"]) for r in by_id[7]} == {(by_id[6][0]["fingerprint"], 6), ("0" * 16, 0)}
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_long_texts_in_steps(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "B", " ", "é", "\n", "xyz", "  "]) for _ in range(3000)) + " " + "Q" * 400 + " end " + "z" * 300
    want = plain_fingerprint(text)
    assert simhash.fingerprint(text.encode(), 3) == want
    for piece in (7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode(), 3) == want


# --- whitening


def plain_whitening(rows, components=16):
    """x of valid rows, and per row and component |whitened|; all in dense numpy, exact sums in Python."""
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    own = np.array([[float(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x.values()])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x.values()]
    return dict(zip(x, deviation, strict=True)), n, dict(zip(x, own @ axes / np.sqrt(e), strict=True)), e / (y * y).sum() * n


def compare(got, rows, components=16):
    deviation, n, white, explained = plain_whitening(rows, components)
    count = min(components, len(next(iter(white.values()))))
    at = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(at) == len(white) * count
    table = np.array([[at[k, c]["whitened"] for c in range(1, count + 1)] for k in white])
    want = np.array(list(white.values()))
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table - want * sign).max() < 1e-8
    for (k, c), r in at.items():
        assert (r["n"], r["deviation"]) == (n, deviation[k]) and abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_query_is_dense_algebra(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(queries.op11_whitening(spark, sf_dir).collect(), rows)


def test_whitening_of_many_parts_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=5) * [9, 4, 3, 1, 0.5] + 7).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(400)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 5), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(40).withColumns({"x": F.lit(1), "id": F.lit(2), "n": F.lit(3), "component": F.lit(4)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = whitening.whiten(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    compare(got, rows)
    assert {r["component"] for r in whitening.whiten(df, components=2).collect()} == {1, 2}


def test_whitening_without_spread(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])]
    one = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    # all on a line: one component
    line = spark.createDataFrame([(k, [k / 64, 2 * k / 64, 3.0]) for k in range(50)], "vec_id long, embedding array<double>")
    for r in whitening.whiten(line).collect():
        assert (r["whitened"] is None) == (r["component"] > 1) and abs(r["explained"] - (r["component"] == 1)) < 1e-12
        assert r["component"] > 1 or abs(abs(r["whitened"]) - abs(r["vec_id"] - 24.5) / np.std(range(50))) < 1e-9
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None for r in whitening.whiten(far).collect() if r["vec_id"] < 3)
    assert whitening.whiten(far.limit(0)).count() == 0


def test_secular_equations_against_dense_algebra():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 40):
        for trial in range(60):
            d = np.sort(rng.random(k) * 10.0 ** rng.integers(-3, 6))
            if trial % 4 == 1:
                d[: k // 2] = d[0]
            if trial % 4 == 2:
                d = np.sort(np.round(d * 3))
            z = rng.normal(size=k) * 10.0 ** rng.integers(-6, 4)
            if trial % 3 == 0:
                z[rng.random(k) < 0.3] = 0
            if trial % 5 == 0:
                z *= 10.0 ** rng.integers(-12, 1, k)
            values, vectors = whitening.secular(d, z)
            dense, size = np.diag(d) + np.outer(z, z), max(np.abs(d).max(), z @ z, 1e-300)
            assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
            assert np.abs(dense @ vectors - vectors * values).max() < 1e-13 * size
