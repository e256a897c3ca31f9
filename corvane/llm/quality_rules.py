"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text: lengths, symbol
ratio, stop-word ratio and line ratios.  No user function runs and nothing is
shuffled.  Intermediate arrays are bound with ``let``, so that the text is split
once.

Defined results: a null text counts as empty; an empty text has zero words and
is rejected; repeated rows get equal verdicts; an empty table gives an empty
result.  The result holds the id column and the metrics only, so further input
columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, unused, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by this are or an from".split(),
    "fr": "de la le et les des en un une du que est pour qui dans sur par au avec".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als".split(),
    "es": "de la que el en y los se del las un por con una su para es no lo como".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``least <= metric <= most``."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table.  Ratios are over words or over lines that have a word.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_ratio", most=0.10),
    Rule("letter_word_ratio", least=0.70),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.50),
    Rule("bullet_line_ratio", most=0.90),
    Rule("ellipsis_line_ratio", most=0.30),
    Rule("repeat_word_ratio", most=0.50),
)


def _repeated(words: Column) -> Column:
    """Number of words covered by a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hashes; within one text a false match has
    probability of about n_words**2 / 2**65.
    """
    last = F.size(words) - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: (F.get(ordered, j)["h"] == F.get(ordered, j - 1)["h"]) | (F.get(ordered, j)["h"] == F.get(ordered, j + 1)["h"]),
        )
        starts = F.sort_array(F.transform(twice, lambda j: F.get(ordered, j)["p"]))
        return let(
            starts,
            lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
                F.aggregate(
                    F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0))),
                    F.lit(0),
                    lambda n, j: n + F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - F.get(p, j)), F.lit(3)),
                )
            ),
        )

    # Most texts repeat no window, which the number of distinct hashes tells.
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed(h), covered)))
    return F.when(last < 1, F.lit(0)).otherwise(counted)


def metrics(text: Column) -> Column:
    """Struct of counts over one whole text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    symbols = F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("long").alias("n_lines"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    F.size(F.filter(x, lambda s: s.rlike(r"^[\x20\t]*[-*•‣]"))).cast("long").alias("n_bullet_lines"),
                    F.size(F.filter(x, lambda s: s.rlike(r"(\.\.\.|…)[\x20\t\r]*$"))).cast("long").alias("n_ellipsis_lines"),
                ),
            ).alias("lines"),
        )

    return let(words_of(text), of)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over a metrics struct."""
    n, lines = m["n_words"], m["lines"]["n_lines"]
    values = {
        "n_words": n,
        "mean_word_chars": _ratio(m["word_chars"], n),
        "symbol_ratio": _ratio(m["n_symbols"], n),
        "letter_word_ratio": _ratio(m["n_letter_words"], n),
        "stop_word_ratio": _ratio(m["n_stop_words"], n),
        "repeat_word_ratio": _ratio(m["n_repeat_words"], n),
        "dup_line_ratio": _ratio(m["lines"]["n_dup_lines"], lines),
        "bullet_line_ratio": _ratio(m["lines"]["n_bullet_lines"], lines),
        "ellipsis_line_ratio": _ratio(m["lines"]["n_ellipsis_lines"], lines),
    }
    verdict = F.lit(True)
    for rule in rules:
        value = values[rule.metric]
        if rule.least is not None:
            verdict = verdict & (value >= F.lit(rule.least))
        if rule.most is not None:
            verdict = verdict & (value <= F.lit(rule.most))
    return verdict


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``df``: id, metrics, ``base_failed`` and ``kept``."""
    scored = df.select(F.col(id_col), metrics(F.col(text_col)).alias("m"))
    m = F.col("m")
    return scored.select(
        F.col(id_col), m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), m["n_stop_words"].alias("n_stop_words"),
        m["n_letter_words"].alias("n_letter_words"), m["lines"]["n_lines"].alias("n_lines"), m["lines"]["n_bullet_lines"].alias("n_bullet_lines"),
        m["lines"]["n_ellipsis_lines"].alias("n_ellipsis_lines"), base_failed(m).alias("base_failed"), (~base_failed(m) & compile_rules(m, rules)).alias("kept"),
    )


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with exactly the columns of ``df``."""
    m = unused(df, "quality_metrics")
    scored = df.withColumn(m, metrics(F.col(text_col)))
    return scored.where(~base_failed(F.col(m)) & compile_rules(F.col(m), rules)).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    ratio = "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0 END".format
    value = {
        "n_words": "n_words", "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "letter_word_ratio": ratio("n_letter_words", "n_words"), "stop_word_ratio": ratio("n_stop_words", "n_words"), "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
    }
    tests = [f"{value[r.metric]} >= {r.least}" for r in RULES if r.least is not None] + [f"{value[r.metric]} <= {r.most}" for r in RULES if r.most is not None]
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
    ), w AS (
      SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
    ), p AS (
      SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
    ), r AS (
      SELECT rid, i FROM p QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
    ), cover AS (
      SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
    ), lines AS (
      SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
    ), m AS (
      SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
        len(ls)::BIGINT AS n_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\t]*[-*\x{{2022}}\x{{2023}}]')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\t\r]*$')))::BIGINT AS n_ellipsis_lines
      FROM w JOIN lines USING (rid) LEFT JOIN cover USING (rid)
    )
    SELECT * EXCLUDE (rid), NOT base_failed AND {" AND ".join(tests)} AS kept
    FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    """


SQL = _sql()
