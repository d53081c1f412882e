"""Operator 1, quality rules: a threshold table compiled into one projection.

Everything is a built-in Spark expression, evaluated row by row without a
shuffle: measures (lengths, symbols, stop words, lines, repeated 3-word
windows) and then one boolean per rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.common import documents, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"
NGRAM = 3

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is it that for was on with as be by at this are or an not from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "fr": "de la le et les des en un une du dans est que pour par sur au avec ne se ce qui",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; an open side is None. ``measure`` is SQL over
    the measure columns; a NULL measure (no words, no lines) passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def column(self) -> Column:
        m = F.expr(self.measure)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (m >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (m <= F.lit(float(self.high)))
        return F.coalesce(ok, F.lit(True))


RULES: tuple[Rule, ...] = (
    Rule("word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", None, 0.20),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.06, None),
    Rule("upper_ratio", "n_upper / nullif(word_chars, 0)", None, 0.40),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.50),
    Rule("repeated_windows", "n_repeat_words / nullif(n_words, 0)", None, 0.30),
)


def stop_word_forms() -> list[str]:
    words = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    return words + [w.capitalize() for w in words]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measures of each whole text, all long.

    Words are runs of characters other than ASCII white space.  A null or
    empty text has no words: every measure is 0.  Repeated rows are measured
    each on its own; other columns of ``docs`` are not read.  3-word windows
    are compared by 64-bit hashes (within one text only).
    """
    t = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    trimmed = F.btrim("t", F.lit(" \t\n\u000b\f\r"))
    t = t.select("id", "t", F.when(trimmed == "", F.array().cast("array<string>"))
                 .otherwise(F.split(trimmed, WHITE)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("w") >= NGRAM, F.transform(
        F.sequence(F.lit(0), F.size("w") - NGRAM),
        lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(NGRAM)]))
    ).otherwise(F.array().cast("array<bigint>"))
    t = t.select(
        "id", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("w", lambda x: x.isin(stop_word_forms()))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        lines.alias("lines"), windows.alias("h"))
    # Only texts with a repeated window sort their (hash, position) pairs.
    t = t.withColumn("z", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    t = t.withColumn("p", F.when(F.col("z").isNotNull(), F.sort_array(F.filter(
        F.transform("z", lambda s, k: F.when(
            (s["h"] == F.get("z", k + 1)["h"]) | ((k > 0) & (s["h"] == F.get("z", k - 1)["h"])), s["i"])
            .otherwise(F.lit(-1))), lambda i: i >= 0))))
    covered = F.aggregate(
        F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))),
                   lambda a, b: F.least(F.lit(NGRAM), F.coalesce(b - a, F.lit(NGRAM))).cast("long")),
        F.lit(0).cast("long"), lambda s, x: s + x)
    found = F.struct(
        "n_words", "word_chars", "n_symbols", "n_upper", "n_stop_words", "n_distinct_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # One generated row a text: a filter on a measure stays above it.  Pushed
    # below, it would be written out with all it rests on, inside the lambdas,
    # and long texts would cost their square.
    return t.select(F.col("id").alias(id_col), F.inline(F.array(found)))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id",
                  text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Measures, ``base_failed``, one ``rule_<name>`` boolean per rule and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_pct``
    percent of the words in repeated windows.  ``kept``: not ``base_failed``
    and every rule holds.  Null and empty texts fail the base rule; an empty
    table gives an empty result.
    """
    m = measures(docs, id_col, text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = m.select("*", base.alias("base_failed"), *[r.column().alias(f"rule_{r.name}") for r in rules])
    verdict = ~F.col("base_failed")
    for r in rules:
        verdict = verdict & F.col(f"rule_{r.name}")
    return out.withColumn("kept", verdict)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: counts, base_failed and kept of every document."""
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(r: Rule) -> str:
    m = r.measure.replace(" / ", "::DOUBLE / ")
    parts = [f"{m} >= {r.low}"] * (r.low is not None) + [f"{m} <= {r.high}"] * (r.high is not None)
    return f"coalesce({' AND '.join(parts)}, true)"


def oracle_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in stop_word_forms())
    rules = " AND ".join(_rule_sql(r) for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
        len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept
FROM b"""
