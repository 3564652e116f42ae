"""Packed text formats: writers and readers of lines whose cells hold several numbers.

A reader takes lines as a DataFrame with the column ``value`` (``spark.read.text`` gives it for plain,
gzip and bzip2 files, ``midas.lz4_lines`` for LZ4 frames), a writer makes them; a line is
one group, so a writer's group is the square of a cohort or the sites of one sample's spectrum.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.sources.midas import packed_cells


def exploded(lines: DataFrame, heads: dict[str, Column], each: Column, name: str = "_c") -> DataFrame:
    """``heads`` of each line with its cells ``each``, a row a cell.

    A line is split once, into a table of its own: what stands beside a generator is computed
    again for every cell, which for a line of n cells costs the square of n.
    """
    made = lines.select(*[c.alias(h) for h, c in heads.items()], each.alias("_cells"))
    return made.select(*heads, F.explode("_cells").alias(name))


def cells(rows: DataFrame, by: list[str], values: list[str], sep: str = "\t", inner: str = ",") -> DataFrame:
    """A line for each ``by``: its fields, then a cell ``a,b,...`` for each row in the order of ``values``."""
    packed = F.array_sort(F.collect_list(F.struct(*values)))
    text = F.array_join(F.transform(packed, lambda x: F.concat_ws(inner, *[x[v].cast("string") for v in values])), sep)
    return rows.groupBy(*by).agg(text.alias("_cells")).select(F.concat_ws(sep, *[F.col(b) for b in by], "_cells").alias("value"))


def from_cells(lines: DataFrame, by: list[str], values: dict[str, str], sep: str = "\t") -> DataFrame:
    """The rows of ``cells``; ``values`` names the numbers of a cell with their types."""
    return packed_cells(lines, by, list(values), sep).select(*by, *[F.col(v).cast(t).alias(v) for v, t in values.items()])


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_csv(F.struct(*rows.columns)).alias("value"))


def from_csv(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of comma-separated lines; a line that begins with the first column's name is a header."""
    first = schema.split()[0]
    return lines.filter(~F.col("value").startswith(f"{first},")).select(F.from_csv("value", schema).alias("r")).select("r.*")


def ragged(changes: DataFrame, totals: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """A line for each row of ``totals`` (``by``, n_opportunities, error): these, then its changes as cells ``a;b;...``."""
    packed = changes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(";", *[F.col(f).cast("string") for f in fields]))), ",").alias("_c"))
    rows = totals.join(packed, by, "left")
    return rows.select(F.concat_ws(",", *[F.col(c).cast("string") for c in (*by, "n_opportunities", "error")], F.nullif(F.col("_c"), F.lit(""))).alias("value"))


def from_ragged(lines: DataFrame, by: list[str], fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(totals, changes) of ``ragged`` lines."""
    parts = F.split("value", ",")
    n = len(by)
    # the cells stay whole, whatever their number
    front = F.split("value", ",", n + 3)
    totals = lines.select(*[F.get(front, F.lit(k)).alias(b) for k, b in enumerate(by)], F.get(front, F.lit(n)).cast("bigint").alias("n_opportunities"), F.get(front, F.lit(n + 1)).cast("double").alias("error"))
    each = exploded(lines, {b: F.get(parts, F.lit(k)) for k, b in enumerate(by)}, F.slice(parts, n + 3, F.greatest(F.size(parts) - n - 2, F.lit(0))))
    inner = F.split("_c", ";")
    return totals, each.select(*by, *[F.get(inner, F.lit(k)).cast(t).alias(f) for k, (f, t) in enumerate(fields.items())])


def ratio_cells(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Wide lines of binned ratios: a cell ``at:num:den:count`` for each bin."""
    return cells(rows, by, [at, "num", "den", "n"], ",", ":")


def from_ratio_cells(lines: DataFrame, by: list[str], at: str) -> DataFrame:
    parts = F.split("value", ",")
    each = exploded(lines, {b: F.get(parts, F.lit(k)) for k, b in enumerate(by)}, F.slice(parts, len(by) + 1, F.size(parts)))
    inner = F.split("_c", ":")
    kinds = {at: "bigint", "num": "double", "den": "double", "n": "bigint"}
    return each.select(*by, *[F.get(inner, F.lit(k)).cast(t).alias(v) for k, (v, t) in enumerate(kinds.items())])


def contig_lists(rows: DataFrame) -> DataFrame:
    """A line for each species and contig: ``species,contig,pos:value;pos:value``."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prevalence"))), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["prevalence"].cast("string"))), ";")
    return rows.groupBy("species", "contig").agg(text.alias("_t")).select(F.concat_ws(",", "species", "contig", "_t").alias("value"))


def from_contig_lists(lines: DataFrame) -> DataFrame:
    parts = F.split("value", ",", 3)
    each = exploded(lines, {"species": F.get(parts, F.lit(0)), "contig": F.get(parts, F.lit(1))}, F.split(F.get(parts, F.lit(2)), ";"))
    return each.select("species", "contig", F.substring_index("_c", ":", 1).cast("bigint").alias("pos"), F.substring_index("_c", ":", -1).cast("double").alias("prevalence"))


def set_lines(rows: DataFrame, name: str, member: str) -> DataFrame:
    """``name: a, b, c`` for each group, N/A for an empty one (a null member)."""
    got = rows.groupBy(name).agg(F.array_join(F.array_sort(F.collect_set(member)), ", ").alias("_m"))
    return got.select(F.concat(F.col(name), F.lit(": "), F.when(F.col("_m") == "", F.lit("N/A")).otherwise(F.col("_m"))).alias("value"))


def from_set_lines(lines: DataFrame, name: str, member: str) -> DataFrame:
    parts = F.split("value", ":", 2)
    rows = exploded(lines.filter(F.col("value").contains(":")), {name: F.trim(F.get(parts, F.lit(0)))}, F.split(F.get(parts, F.lit(1)), ","), member)
    return rows.withColumn(member, F.trim(member)).filter(~F.col(member).isin("", "N/A"))


def names(lines: DataFrame) -> DataFrame:
    """One name a line; blank lines are none."""
    return lines.select(F.trim("value").alias("name")).filter("name <> ''")


def snp_lines(sites: DataFrame) -> DataFrame:
    """Annotated SNPs: ``contig|pos|gene|type|p``, then a cell ``sample,alt,depth`` for each sample."""
    key = F.concat_ws("|", "contig", F.col("pos").cast("string"), "gene_id", "variant_type", F.col("pvalue").cast("string"))
    return cells(sites.withColumn("_key", key), ["species", "_key"], ["sample", "alt", "depth"])


def from_snp_lines(lines: DataFrame, most_p: float = 0.05) -> DataFrame:
    """Site rows of annotated SNP lines whose p-value is below ``most_p``."""
    parts = F.split("value", "\t")
    key = F.split(F.get(parts, F.lit(1)), r"\|")
    heads = {"species": F.get(parts, F.lit(0)), **{n: F.get(key, F.lit(k)) for k, n in enumerate(("contig", "pos", "gene_id", "variant_type", "pvalue"))}}
    rows = exploded(lines, heads, F.slice(parts, 3, F.size(parts)))
    inner = F.split("_c", ",")
    got = rows.filter(F.col("pvalue").cast("double") < most_p)
    return got.select("species", "contig", F.col("pos").cast("bigint").alias("pos"), "gene_id", "variant_type", F.get(inner, F.lit(0)).alias("sample"), F.get(inner, F.lit(1)).cast("bigint").alias("alt"), F.get(inner, F.lit(2)).cast("bigint").alias("depth"))


def wide(rows: DataFrame, key: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """The matrix of ``value`` by ``key`` and ``column``, as the text matrices hold it."""
    return rows.groupBy(key).pivot(column, columns).agg(F.first(value))


def general(value: Column, digits: int = 6) -> Column:
    """A number as ``%g`` prints it with ``digits`` significant digits: with an exponent below 1e-4 and from 10 ** ``digits`` on, and rounded from its exact binary value."""

    @F.pandas_udf("string")
    def text(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda x: f"%.{digits}g" % x)

    # Arrow gives a null as a missing number, so nulls are told apart here
    return F.when(value.isNotNull(), text(value.cast("double")))
