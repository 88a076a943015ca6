"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import ann, bpe, chat, fim, langid, simhash, token_counts, whitening
from skyloom.llm.common import table
from skyloom.llm.exact_dedup import exact_dedup
from skyloom.llm.jaccard import jaccard_groups
from skyloom.llm.license_scan import license_places
from skyloom.llm.mixing import mixture
from skyloom.llm.secret_scan import RULES, named, secret_spans


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = chat.read_back(chat.examples(turns.unionByName(more)))
    said = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP4 = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, 11 + length(role) + length(text) + 4 * (length(text) - length(replace(text, '&', '')))
              + 3 * (length(text) - length(replace(text, '[', ''))) + 4 * (length(role) - length(replace(role, '&', '')))
              + 3 * (length(role) - length(replace(role, '[', ''))) + 3 * (length(role) - length(replace(role, ']', ''))) AS chars
    FROM rows
), ends AS (
    SELECT *, sum(chars) OVER t AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last
    FROM sized WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR last THEN stop ELSE 0 END) AS BIGINT) AS formatted_chars
FROM ends GROUP BY conv_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_places(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    # the longer the mandatory wording, and the less of the place is free, the surer
    closest = F.array_max(F.transform("places", lambda p: p["must"] / (p["must"] + 4) * p["must"] / (p["stop"] - p["start"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(closest, F.lit(0.0)).alias("score"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = [k for k, r in enumerate(RULES) if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(RULES[k].kind) for k in base],
        F.sha2(named(F.filter("spans", lambda s: s["order"].isin(base))), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def _op8() -> str:
    """SQL of all rules: texts between matches and matches give the positions."""
    either = lambda p: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.pattern
        if "(?i:" in pattern:
            head, rest = pattern.split("(?i:", 1)
            inner, rest = rest.split(")", 1)
            pattern = f"{head}(?:{either(inner)}){rest}"
        pattern = pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, {k} AS k, '{r.kind}' AS kind, i, gap, hit, part FROM (
    SELECT doc_id, unnest(range(len(hits))) AS i, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit, unnest(parts) AS part FROM (
        SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
               regexp_extract_all(t, '{pattern}', {r.group}) AS parts FROM docs)) WHERE true""")
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
    base = ", ".join(str(k) for k, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(s.k) FILTER (s.k = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({" UNION ALL ".join(parts)}
), placed AS (
    SELECT doc_id, k, kind, part, CAST(sum(length(gap) + length(hit)) OVER w AS BIGINT) AS stop, CAST(sum(length(gap) + length(hit)) OVER w AS BIGINT) - length(hit) AS start
    FROM raw WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)
), s AS (
    SELECT doc_id, k, start, kind || ':' || start || ':' || stop AS name FROM placed WHERE length(part) >= CASE k {least} END
)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(s.name, ',' ORDER BY s.start, s.k) FILTER (s.k IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(s.name, ',' ORDER BY s.start, s.k), '') AS spans
FROM docs d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12 = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), h AS (
    SELECT doc_id, t, n, CAST('0x' || d[1:8] AS UBIGINT) AS h1, CAST('0x' || d[9:16] AS UBIGINT) AS h2,
           CAST('0x' || d[17:24] AS UBIGINT) AS h3, CAST('0x' || d[25:32] AS UBIGINT) AS h4
    FROM drawn
), cut AS (
    SELECT doc_id, t, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), k=3, distance=3)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_nearest_vectors, op4_chat_format, op5_license_scan, op6_exact_dedup, op7_mix_sources, op8_secret_scan, op9_token_counts, op10_jaccard_join, op11_whitening, op12_fill_in_middle, op13_simhash)}
ORACLES = {"op4_chat_format": OP4, "op6_exact_dedup": OP6, "op8_secret_scan": _op8(), "op12_fill_in_middle": OP12}
