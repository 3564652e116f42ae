"""Sinks: columnar tables by species, and the packed text forms that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, by: str = "species", mode: str = "error", files: int = 8) -> None:
    """Parquet, a folder for each species; rows are dealt by species and a salt so that a large one has many files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(F.col(by), salt).write.mode(mode).partitionBy(by).parquet(path)


def packed(df: DataFrame, names: list[str], order: list[str], cells: list[str], sep: str = "\t") -> DataFrame:
    """One line per ``names`` with cells ``a,b,...`` in ``order``; a line has the cells of one sample or site."""
    cell = F.concat_ws(",", *[F.col(c).cast("string") for c in cells])
    rows = df.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, cell.alias("_cell")))), lambda x: x["_cell"]).alias("_cells"))
    return rows.select(F.concat_ws(sep, *names, F.array_join("_cells", sep)).alias("value"))


def text(lines: DataFrame, path: str, compression: str = "bzip2", mode: str = "error") -> None:
    lines.select("value").write.mode(mode).option("compression", compression).text(path)


def csv(df: DataFrame, path: str, sep: str = ",", compression: str = "gzip", mode: str = "error") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=True, compression=compression)


def gene_set_lines(sets: DataFrame) -> DataFrame:
    """``species: gene, gene`` lines."""
    return sets.groupBy("species").agg(F.array_join(F.array_sort(F.collect_set("gene_id")), ", ").alias("_g")).select(F.concat(F.col("species"), F.lit(": "), F.col("_g")).alias("value"))


def significant(column, digits: int = 6):
    """A number with ``digits`` significant digits, as %g gives it without an exponent."""
    size = F.when(column == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(column)))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.round(column * scale) / scale


def phylip(pairs: DataFrame, value: str) -> str:
    """A distance matrix as text; the cohort's pairs come to the driver, as the format is one small file."""
    rows = pairs.select("sample_1", "sample_2", value).collect()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    d = {(r[0], r[1]): r[2] for r in rows} | {(r[1], r[0]): r[2] for r in rows}
    return "\n".join([str(len(names)), *[" ".join([a, *[f"{d.get((a, b), 0.0):g}" for b in names]]) for a in names]])


def site_matrices(counts: DataFrame, names: list[str], folder: str, compression: str = "bzip2", mode: str = "error") -> None:
    """The wide depth and reference-frequency matrices of one species' counts, a folder of lines each, as the readers take them; ``names`` are the samples."""
    site = F.concat_ws("|", "contig", F.col("pos").cast("string")).alias("site_id")
    ref = F.coalesce(F.try_divide((F.col("depth") - F.col("alt")).cast("double"), F.nullif(F.col("depth").cast("double"), F.lit(0.0))), F.lit(0.0))
    for file, value in (("snps_depth", F.col("depth")), ("snps_ref_freq", ref)):
        rows = counts.select(site, "sample", value.alias("v"))
        wide = rows.groupBy("site_id").pivot("sample", names).agg(F.first("v"))
        csv(wide.select("site_id", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names]), f"{folder}/{file}.txt", "\t", compression, mode)
