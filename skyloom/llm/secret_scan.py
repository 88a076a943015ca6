"""Secret scan by a trigram inverted index.

Each rule is a regular expression. Its Boolean trigram query is an OR of clauses, each an AND of trigrams
(lower case) that every match must contain; small character classes are expanded. The index holds, for each block of
documents and each trigram that some query names, its posting list: the documents of the block whose text has it.
Posting lists are intersected by clause and united by rule, and only documents so found are verified with its
expression. Rules with a clause that has no mandatory trigram scan every text. The queries only ever let
too many documents through, so the spans are those of the plain expressions.

Spans are leftmost and do not overlap within a kind; positions count code points from 0, end exclusive. Spans that start at
one place come in the order of their rules.

Defined results: null texts are empty and hold nothing; repeated rows and rows of the same id are verified each on its own text; very
long texts are scanned whole, and the cost of their spans grows with their number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import durable, small


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped; base rules are those of the contract."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: In the order of their kinds. A maximal run of hex digits is long enough or not as a whole, so the length is part of its pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN[A-Z ]{0,20} PRIVATE KEY-----"),
    Rule("git_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"(?:xoxa|xoxb|xoxp|xoxr|xoxs)-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A class of so many letters at most is expanded, while a query has no more clauses than MAX_CLAUSES.
FEW, MAX_CLAUSES = 8, 64
#: Documents whose posting lists one row of the index holds, about.
BLOCK = 4096
#: Spans that are appended to one array before it is put aside.
RUN = 256

Clauses = list[list[str]]


def _few(members) -> list[str]:
    """The lower-case letters of a small character class, or none."""
    out: list[str] = []
    for op, value in members:
        if op is sre.LITERAL:
            out.append(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < FEW:
            out += [chr(c).lower() for c in range(value[0], value[1] + 1)]
        else:
            return []
    return sorted(set(out)) if len(out) <= FEW else []


def _walk(items, clauses: Clauses) -> Clauses:
    """Extends each clause's literal runs by a parsed sequence; an open run is the last string of its clause."""
    for op, value in items:
        if op is sre.LITERAL:
            clauses = [[*c[:-1], c[-1] + chr(value).lower()] for c in clauses]
        elif op is sre.IN and (few := _few(value)) and len(clauses) * len(few) <= MAX_CLAUSES:
            clauses = [[*c[:-1], c[-1] + letter] for c in clauses for letter in few]
        elif op is sre.SUBPATTERN:
            clauses = _walk(value[3], clauses)
        elif op is sre.BRANCH:
            clauses = [x for branch in value[1] for x in _walk(branch, clauses)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            if low:
                clauses = _walk(inner, clauses)
            if not low or high != 1:
                clauses = [[*c, ""] for c in clauses]
        elif op is not sre.AT:
            clauses = [[*c, ""] for c in clauses]
    return clauses


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of a pattern's query; an empty clause means that the rule must scan every text."""
    clauses = [frozenset(run[i : i + 3] for run in clause for i in range(len(run) - 2) if run.isascii()) for clause in _walk(_parser.parse(pattern), [[""]])]
    return list(dict.fromkeys(clauses))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """block, lists: for each block of documents a map from trigram to the keys of those whose text has it. ``rows`` has key and text."""
    blocks = rows.count() // BLOCK + 1
    own = F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))[0]
    each = rows.select("key", F.explode(own).alias("trigram")).withColumn("block", F.pmod("key", F.lit(blocks)))
    lists = each.groupBy("block", "trigram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))


def candidates(rows: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """key, kinds: the indexed rules whose query the document satisfies. ``rows`` has key and text."""
    index = postings(rows, sorted({t for clauses in queries.values() for c in clauses for t in c}))
    listed = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), F.array().cast("array<bigint>"))
    found = lambda clause: reduce(F.array_intersect, map(listed, sorted(clause)))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.flatten(F.array(*map(found, clauses)))).alias("keys")) for kind, clauses in queries.items()]
    hits = index.select(F.inline(F.array(*kinds))).select("kind", F.explode("keys").alias("key"))
    return hits.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int) -> Column:
    """The rule's spans in ``text``: array of start, order, stop, kind. Texts between matches and matches give the positions."""
    whole, part = (F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    gaps = F.split("text", rule.pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), whole.alias("match"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        full = F.size(acc["run"]) >= RUN
        run, runs = F.when(full, empty).otherwise(acc["run"]), F.when(full, F.array_append(acc["runs"], acc["run"])).otherwise(acc["runs"])
        return F.struct(stop.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.array_append(run, span)).otherwise(run).alias("run"), runs.alias("runs"))

    none = F.struct(F.lit(0).alias("at"), empty.alias("run"), F.array().cast("array<array<struct<start:int,order:int,stop:int,kind:string>>>").alias("runs"))
    folded = F.aggregate(zipped, none, step, lambda acc: F.concat(F.flatten(acc["runs"]), acc["run"]))
    return F.when(F.col("text").rlike(rule.pattern), folded).otherwise(empty)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, spans (array of start, order, stop, kind, sorted)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: c for k, c in queries.items() if all(c)}
    if indexed:
        hits = durable(candidates(rows, indexed))
        rows = rows.join(small(hits, 200), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string>>")
    found = [F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), _spans(r, k)).otherwise(none) if r.kind in indexed else _spans(r, k) for k, r in enumerate(rules)]
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.concat(*found)).alias("spans"))


def named(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
