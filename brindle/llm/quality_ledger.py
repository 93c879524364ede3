"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, policies are masks over the bits.

`ledger` gives each document its measurements and fail_bits. A policy is a named, versioned mask; applying one, or asking
what each of its rules removes alone, reads the bits and never the text. DataFrame expressions only.

Defined cases: null, empty and white-space texts have no words and fail `few_words`; every measurement is 0. Repeated rows
and null ids are rows like any other. Very long texts are sorted within the row: memory is a few times the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "".join(map(chr, range(65, 91)))


@dataclass(frozen=True)
class Rule:
    """name; failed: SQL over the measurements that is true where a document fails."""

    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: A rule's place is its bit: append only, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 30 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
)
POLICIES = (
    Policy("base", 1, ("few_words", "repeated_words")),
    Policy("web", 1, ("few_words", "repeated_words", "symbols", "repeated_lines")),
    Policy("web", 2, ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting")),
)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << k for k, r in enumerate(rules) if r.name in policy.rules)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements. A word is [^\\x20\\x09-\\x0D]+."""
    t = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", t.alias("t")).select(
        "doc_id", "t",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("ls"),
    )
    hashed = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        _without(F.col("t"), SPACE).alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).alias("n_symbols"),
        (F.length("t") - _without(F.col("t"), UPPER)).alias("n_upper"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        # the 3-word windows' hashes; none for fewer than three words
        F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))").alias("h"),
    )
    # most texts repeat no window, which one pass of a hash set shows
    ranked = hashed.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> struct(x as h, i as i))) end"))
    placed = ranked.withColumn("p", F.expr("sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h or x.h <=> get(s, k + 1).h), x -> x.i))"))
    cover = F.expr("coalesce(aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)")
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", cover.alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) to doc_id, the measurements and fail_bits: bit k is set where rule k fails."""
    bits = F.expr(" | ".join(f"(case when {r.failed} then {1 << k}L else 0L end)" for k, r in enumerate(rules)))
    return measure(docs).withColumn("fail_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def verdicts(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a column <name>_v<version> for each policy."""
    return led.select("*", *(passes(p).alias(f"{p.name}_v{p.version}") for p in policies))


def ablations(led: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents kept, kept without that rule, and failed by that rule.

    The ledger is first counted by fail_bits (at most 2**rules rows), combined before the shuffle.
    """
    counts = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    asked = [(p.name, p.version, r.name, mask(p, rules), 1 << k) for p in policies for k, r in enumerate(rules) if r.name in p.rules]
    # a struct for each question, so that one pass over the counts answers them all
    kept = [
        F.struct(
            F.lit(n).alias("policy"), F.lit(v).alias("version"), F.lit(r).alias("rule"),
            F.when(F.expr(f"fail_bits & {m}L = 0"), F.col("n")).otherwise(0).alias("kept"),
            F.when(F.expr(f"fail_bits & {m & ~b}L = 0"), F.col("n")).otherwise(0).alias("kept_without"),
            F.when(F.expr(f"fail_bits & {b}L <> 0"), F.col("n")).otherwise(0).alias("failed"),
        )
        for n, v, r, m, b in asked
    ]
    rows = counts.select(F.explode(F.array(*kept)).alias("x")).select("x.*")
    return rows.groupBy("policy", "version", "rule").agg(*(F.sum(c).alias(c) for c in ("kept", "kept_without", "failed")))


def quality(docs: DataFrame) -> DataFrame:
    """The digest of the ledger: the measurements, base_failed, and kept under the last policy."""
    base, last = POLICIES[0], POLICIES[-1]
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(base)).alias("base_failed"), (passes(base) & passes(last)).alias("kept"), "fail_bits",
    )


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, u.i AS i, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS x FROM w, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM rep, (VALUES (0), (1), (2)) k(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits FROM b
"""
