"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds one ratio of a text. The table is data (``RULES``); ``compiled``
turns it into one boolean column and one column that names the rules a text
fails. All of it is built-in expressions: no user function, no shuffle.

Defined cases: a null or empty text has no words and fails the base rule; extra
columns pass through (a clashing name is replaced by the operator's column);
repeated rows are judged each by itself; an empty table stays empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import BLANKS, documents, fresh, let, without, words_of

#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in is that for it was on with be are as by from this at or "
    "der die das und ist von zu den mit auf ein eine für im nicht "
    "le la les de des et un une que pour en du dans est qui "
    "el los las y del por con para su al lo como"
).split()
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """``least <= metric <= most``; a side that is None is open, as is the rule where the metric is null."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "chars_per_word", 2.0, 16.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_words_per_word", 0.01, None),
    Rule("line_copies", "dup_lines_per_line", None, 0.5),
    Rule("ellipses", "ellipsis_lines_per_line", None, 0.5),
)


#: Low bits of a window's key that hold its start; the others hold its hash.
_AT = 24
_MASK = (1 << _AT) - 1


def _keys(words: Column) -> Column:
    """One number for each 3-word window: the start below, upper hash bits above.

    A text of more than 2**24 words has the hash bits blurred by its starts; that
    only adds windows to compare, as equal windows are told by their words.
    """
    key = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("bigint")))
    return F.sort_array(F.slice(key, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def _alike(keys: Column) -> Column:
    """Starts of the windows whose hash bits another window shares: all that repeat, and very few others."""
    top = lambda x: F.shiftright(x, _AT)
    near = lambda x, k: (top(x) == F.coalesce(top(F.get(keys, k)), F.lit(1 << 62)))
    return F.transform(F.filter(keys, lambda x, k: near(x, k + 1) | near(x, k - 1)), lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int"))


def _repeat_words(words: Column, alike: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more.

    The windows at ``alike`` are sorted with their start; equal ones are then
    neighbours, and the starts that have an equal neighbour, sorted, cover
    ``min(3, gap)`` words each. O(n log n) in the words of one text, within its row.
    """
    windows = F.sort_array(
        F.transform(alike, lambda i: F.struct(F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("t"), i.alias("i")))
    )

    def starts(s: Column) -> Column:
        equal = lambda e, k: e["t"] == F.coalesce(F.get(s, k)["t"], F.lit(""))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: equal(e, k - 1) | equal(e, k + 1)), lambda e: e["i"]))

    zero = F.struct(F.lit(-3).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = lambda d: F.aggregate(
        d,
        zero,
        lambda a, x: F.struct(x.cast("int").alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).cast("bigint").alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(alike) == 0, F.lit(0).cast("bigint")).otherwise(let(windows, lambda s: covered(starts(s))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules build on."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words, lines_, keys, alike = fresh(docs.columns, "_words", "_lines", "_keys", "_alike")
    w, ls = F.col(words), F.col(lines_)
    parts = docs.withColumn(words, words_of(F.col(text))).withColumn(lines_, lines)
    parts = parts.withColumn(keys, _keys(w)).withColumn(alike, _alike(F.col(keys)))
    ends = lambda x: F.rtrim(x, F.lit(BLANKS))
    return parts.withColumns(
        {
            "n_words": F.size(w).cast("bigint"),
            "word_chars": F.length(without(t, BLANKS)).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("bigint"),
            "n_lines": F.size(ls).cast("bigint"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint"),
            "n_ellipsis_lines": F.size(F.filter(ls, lambda x: ends(x).endswith("...") | ends(x).endswith("…"))).cast("bigint"),
            "n_repeat_words": _repeat_words(w, F.col(alike)),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("bigint"),
        }
    ).drop(words, lines_, keys, alike)


def _metrics() -> dict[str, Column]:
    c, per = F.col, lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {
        "n_words": c("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_words_per_word": per("n_stop_words", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "ellipsis_lines_per_line": per("n_ellipsis_lines", "n_lines"),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """For each rule, whether a measured text breaks it."""
    metrics, out = _metrics(), {}
    for r in rules:
        m, broken = metrics[r.metric], F.lit(False)
        if r.least is not None:
            broken = broken | F.coalesce(m < F.lit(float(r.least)), F.lit(False))
        if r.most is not None:
            broken = broken | F.coalesce(m > F.lit(float(r.most)), F.lit(False))
        out[r.name] = broken
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` (comma-joined names) and ``kept``."""
    m = measured(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in compiled(rules).items()])) if rules else F.array().cast("array<string>")
    return m.withColumn("base_failed", base).withColumn("failed_rules", F.array_join(named, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``.

    The filter asks for a row number as well, since a filter is not pushed below one:
    pushed, the counts would be computed anew at each of their places in the verdict.
    """
    held = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return judge(held, "_text", rules).withColumn("_number", F.monotonically_increasing_id()).filter("kept and _number >= 0").select("_row.*")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select(*COLUMNS)


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ell,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: list_contains([{stops}], x))) AS BIGINT) AS n_stop
  FROM a LEFT JOIN rep ON a.doc_id = rep.doc_id
), j AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         concat_ws(',', CASE WHEN n_words < 50 THEN 'length' END,
           CASE WHEN n_words > 0 AND (word_chars < 2.0::DOUBLE * n_words OR word_chars > 16.0::DOUBLE * n_words) THEN 'word_length' END,
           CASE WHEN n_words > 0 AND CAST(n_symbols AS DOUBLE) / n_words > 0.1::DOUBLE THEN 'symbols' END,
           CASE WHEN n_words > 0 AND CAST(n_stop AS DOUBLE) / n_words < 0.01::DOUBLE THEN 'stop_words' END,
           CASE WHEN n_lines > 0 AND CAST(n_dup_lines AS DOUBLE) / n_lines > 0.5::DOUBLE THEN 'line_copies' END,
           CASE WHEN n_lines > 0 AND CAST(n_ell AS DOUBLE) / n_lines > 0.5::DOUBLE THEN 'ellipses' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM j
"""


QUERIES = {"op4_quality": op4_quality}
ORACLE = {"op4_quality": _sql()}
