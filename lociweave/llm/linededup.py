"""Line dedup: repeated runs of lines by prefix doubling; later copies go.

A text is the sequence of its lines that hold a word. The suffixes of all
sequences are grouped by their first line, then by their first 2, 4, 8 ... lines:
a group at one level is named by the position of its first member, and the pair of
the names at a place and half a prefix further names the place at the next level.
Groups of one member have no repeat and are dropped, so each level is smaller.
Groups nest as the intervals of a suffix array with that common prefix do, ordered
by first place rather than by the alphabet, since only membership and the first
place matter here.

A run counts as repeated when it has ``MIN_WORDS`` words or more. The shortest
such runs from each line on, and up to each line, make up all longer ones: a line
is in a later copy of a maximal repeated run exactly if it is in a later copy of
one of these. The interval of such a run of ``n`` lines is the pair of names of its
first and last ``2**j`` lines; its first member stays and all others lose the run.
Positions are ordered by document id, then line.

Defined cases: null and empty texts have no lines; lines are compared without the
blanks around them, and lines of blanks are never deleted; rows that share id and
text are one document, and each row gets its result; a null id comes first; extra
columns pass through ``deduplicated``; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import BLANK_RUN, BLANKS, BROADCAST_IDS, documents, opened, written

MIN_WORDS = 20

_AT = ("d", "r", "k")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _full(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull())


def _reach(sizes: Column, least: int) -> Column:
    """For each place, how many items from there on sum to ``least``; 0 if they don't. Items are 1 at least."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"))

    def step(a: Column, x: Column) -> Column:
        done = a["sum"] >= least
        return F.struct(F.when(done, a["n"]).otherwise(a["n"] + 1).alias("n"), F.when(done, a["sum"]).otherwise(a["sum"] + x).cast("bigint").alias("sum"))

    return F.transform(sizes, lambda _, i: F.when(F.get(sizes, i) >= least, F.lit(1)).otherwise(F.aggregate(F.slice(sizes, i + 1, F.lit(least)), start, step, lambda a: F.when(a["sum"] >= least, a["n"]).otherwise(0))))


def line_table(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(d, r, k, h1, h2, ahead, back): each full line with its 128-bit id and the lines that its shortest runs take."""
    t = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("r"), F.transform(F.filter(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.btrim(x, F.lit(BLANKS))).alias("l"))
    ids = F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("2"), x).alias("h2")))
    words = F.transform("l", lambda x: F.size(F.split(x, BLANK_RUN)))
    t = t.select("d", "r", ids.alias("ids"), words.alias("n")).groupBy("d", "r").agg(F.first("ids").alias("ids"), F.first("n").alias("n"))
    t = t.withColumn("ahead", _reach(F.col("n"), least)).withColumn("b", _reach(F.reverse("n"), least))
    t = t.select("d", "r", F.posexplode(F.arrays_zip("ids", "ahead", F.reverse("b").alias("back"))).alias("k", "z"))
    return t.select("d", "r", "k", "z.ids.h1", "z.ids.h2", "z.ahead", "z.back")


def _named(places: DataFrame, by: list[str], name: str) -> DataFrame:
    """``places`` whose key ``by`` others share, with the group's first place as struct ``f``."""
    groups = places.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(F.struct(*_AT)).alias("f"), F.count(F.lit(1)).alias("_count")).filter("_count > 1").drop("_count")
    held = written(groups, name)
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return places.join(held, match).drop(*[f"_{c}" for c in by])


def _at(other: DataFrame, shift: Column, name: str) -> tuple[DataFrame, Column]:
    far = other.select(F.col("d").alias("_d"), F.col("r").alias("_r"), F.col("k").alias("_k"), F.col("f").alias(name))
    return far, F.col("d").eqNullSafe(F.col("_d")) & (F.col("r") == F.col("_r")) & (F.col("k") + shift == F.col("_k"))


def later_copies(lines: DataFrame) -> DataFrame:
    """(d, r, k, n): runs of ``n`` lines from ``k`` on that also stand at an earlier place."""
    level = written(_named(lines, ["h1", "h2"], "level-names").select(*_AT, "f", "ahead", "back"), "level")
    runs = level.select(*_AT, F.col("ahead").alias("n")).filter("n > 0").union(level.filter("back > 0").select("d", "r", (F.col("k") - F.col("back") + 1).cast("int").alias("k"), F.col("back").alias("n"))).distinct()
    runs = written(runs, "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    own = F.struct(*_AT)
    one = runs.filter("n = 1").join(level.select(F.col("d").alias("_d"), F.col("r").alias("_r"), F.col("k").alias("_k"), "f"), F.col("d").eqNullSafe(F.col("_d")) & (F.col("r") == F.col("_r")) & (F.col("k") == F.col("_k")))
    found = [one.filter(F.col("f") != own).select(*_AT, "n")]
    half = 1
    while 2 * half <= longest:
        far, match = _at(level, F.lit(half), "g")
        pairs = level.select(*_AT, "f").join(far, match).select(*_AT, F.col("f").alias("a"), F.col("g").alias("b"))
        level = written(_named(pairs, ["a", "b"], "level-names").select(*_AT, "f"), "level")
        half *= 2
        these = runs.filter((F.col("n") >= half) & (F.col("n") < 2 * half))
        near, here = _at(level, F.lit(0), "a")
        these = these.join(near, here).drop("_d", "_r", "_k")
        far, there = _at(level, F.col("n") - half, "b")
        these = these.join(far, there).select(*_AT, "n", "a", "b")
        found.append(_named(these, ["n", "a", "b"], "run-names").filter(F.col("f") != own).select(*_AT, "n"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``n_lines``, ``deleted_lines`` (places in the text, from 0) and ``clean_text``."""
    lines = written(line_table(docs, key, text, least), "lines")
    gone = later_copies(lines).select("d", "r", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)).alias("k"))
    gone = written(gone.groupBy("d", "r").agg(F.array_sort(F.collect_set("k")).alias("_gone")), "gone")
    rows, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    if rows <= BROADCAST_IDS and places <= 4 * BROADCAST_IDS:
        gone = F.broadcast(gone)
    held = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    out = held.join(gone, F.col("_key").eqNullSafe(F.col("d")) & (F.col("_hash") == F.col("r")), "left")
    out = out.withColumn("_all", _lines(F.col("_text"))).withColumn("_full", _full(F.col("_all")))
    out = out.withColumn("_deleted", F.transform(F.coalesce("_gone", F.array().cast("array<int>")), lambda k: F.get("_full", k)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_deleted"))
    clean = F.when(F.size("_deleted") == 0, F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_all", i)), "\n"))
    return opened(out, docs.columns, {"n_lines": F.size("_full").cast("bigint"), "deleted_lines": F.col("_deleted"), "clean_text": clean})


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("deleted_lines").cast("bigint").alias("n_deleted"), F.array_join(F.transform("deleted_lines", lambda i: i.cast("string")), ",").alias("deleted_lines"), F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"))


ORACLE = {
    "op10_linededup": rf"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), t AS (
  SELECT doc_id, i, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM raw
), l AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(string_split_regex(x, '[\x20\x09-\x0D]+')) AS n FROM t WHERE x <> ''
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM l
), w AS (
  SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + {MIN_WORDS} AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.k) AS s, a.k AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k <= a.k AND b.k > a.k - {MIN_WORDS} AND a.upto - b.upto + b.n >= {MIN_WORDS} GROUP BY a.doc_id, a.k
), g AS (
  SELECT w.doc_id, s, e, string_agg(x, chr(10) ORDER BY k) AS body FROM w JOIN l ON l.doc_id = w.doc_id AND k BETWEEN s AND e GROUP BY ALL
), f AS (
  SELECT doc_id, s, e, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS turn FROM g
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM f JOIN l ON l.doc_id = f.doc_id AND l.k BETWEEN s AND e WHERE turn > 1
), s AS (
  SELECT raw.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN raw.x END, chr(10) ORDER BY raw.i) AS clean, count(gone.i) AS n_deleted,
         coalesce(string_agg(CAST(gone.i AS VARCHAR), ',' ORDER BY raw.i), '') AS deleted_lines
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.i = gone.i GROUP BY raw.doc_id
), n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, deleted_lines, md5(coalesce(clean, '')) AS clean_md5
FROM s LEFT JOIN n ON s.doc_id = n.doc_id
"""
}
QUERIES = {"op10_linededup": op10_linededup}
