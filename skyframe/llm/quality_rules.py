"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy
is a mask over these bits, so a new policy, or the effect of leaving a rule out, needs no second look at the texts.

Defined results: a null text counts as empty and fails ``few_words``; null ids, repeated rows and extra columns pass
through unchanged (one ledger row per input row; input columns named m, fail_bits or kept are replaced); an empty table gives an empty ledger. Windows of three words are
compared by a 64-bit hash, inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, split_words, stage_table

SYMBOLS = "#*$%&|<>"

#: Rule name -> condition under which it fails; the position is the bit.
RULES = {
    "few_words": "m.n_words < 50",
    "repeated_words": "100 * m.n_repeat_words > 50 * m.n_words",
    "symbols": "10 * m.n_symbols > m.n_words",
    "shouting": "m.n_upper > m.n_lower",
    "repeated_lines": "m.n_lines >= 4 AND 10 * m.n_dup_lines > 3 * m.n_lines",
    "word_length": "m.word_chars > 15 * m.n_words OR m.word_chars < 2 * m.n_words",
    "exclamations": "5 * m.n_exclaim > m.n_words",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _count(text: Column, characters: str) -> Column:
    """Characters of the class; all others go in long runs, which is cheaper than a look at each."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Positions covered by the windows that are found twice or more."""

    def covered(ordered: Column) -> Column:
        twice = F.transform(
            ordered,
            lambda x, k: F.when((F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"]),
        )
        spans = F.transform(F.filter(twice, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2))
        return F.size(F.array_distinct(F.flatten(spans)))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ordered, covered)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of each text as columns under ``m``."""
    docs = docs.drop(*{"m", "fail_bits", "kept"} - {text})
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumns({"__w": split_words(t), "__l": lines})
    n = F.size("__w")
    windows = F.transform(
        F.slice("__w", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    staged = staged.withColumn("__h", windows)
    values = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": _count(t, SYMBOLS),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__h")),
        "n_upper": _count(t, "A-Z"),
        "n_lower": _count(t, "a-z"),
        "n_exclaim": _count(t, "!"),
    }
    return staged.select(*docs.columns, F.struct(*(c.alias(k) for k, c in values.items())).alias("m"))


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds measurements ``m`` and failure bits ``fail_bits`` (long): the ledger's rows, before they are stored."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text).withColumn("fail_bits", bits)


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The stored ledger: one row per document with its columns (or those in ``keep``), measurements ``m`` and failure
    bits ``fail_bits`` (long). Policies filter the stored bits and never reach the rules again."""
    rows = marked(docs, text)
    return stage_table(rows if keep is None else rows.select(*keep, "m", "fail_bits"), "ledger")


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many the policy would keep without it.

    Documents are first counted by their bits (at most 2 to the number of rules groups).
    """
    policy = mask(POLICIES[version])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[version]))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]))
    base_bits = F.lit(mask(BASE)).cast("long")
    return rows.select(
        "doc_id",
        *(F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (F.col("fail_bits").bitwiseAND(base_bits) != 0).alias("base_failed"),
        "kept",
        "fail_bits",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy keeps.

    One policy is applied in one pass, so the ledger isn't stored beside the texts. A rejected row explodes into none:
    unlike a filter, that can't move below the rules and have them computed again.
    """
    own = F.struct(*docs.columns).alias("__row")
    rows = apply_policy(marked(docs.select("text", own)))
    return rows.select("__row", F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))).select("__row.*")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower,
             length(t) - length(replace(t, '!', '')) AS n_exclaim
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
        + 8 * (n_upper > n_lower)::INT + 16 * (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)::INT
        + 32 * (word_chars > 15 * n_words OR word_chars < 2 * n_words)::INT + 64 * (5 * n_exclaim > n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b
"""
QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE = {"op6_quality_rules": OP6_SQL}
