"""Files that other tools read: tables with fixed number formats, M sidecars, result files, summaries."""

from __future__ import annotations

import gzip
import math
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import float_text
from . import members
from .shared import remove

#: Rows of a gzip member at most, so that members stay small however many rows a task writes.
MEMBER_ROWS = 250_000


def _text(df: DataFrame, formats: dict[str, str]) -> list[Column]:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in formats:
            c = F.when(c.isNull(), "").otherwise(F.format_string(formats[name], c))
        elif kind in ("double", "float"):
            c = float_text(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return out


def _parts(spark: SparkSession, folder: str) -> list:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")) or []

    def place(status):  # the task, then its files in turn
        name = status.getPath().getName()
        return int(name.split("-")[1]), int(re.search(r"c([0-9]+)(?:[.].*)?$", name)[1])

    return sorted(found, key=place)


def _join_parts(spark: SparkSession, parts: list, head: str, path: str) -> None:
    """One file of a header line and the parts in order; gzip files of several members are gzip files too.

    Each member tells its length in its header, so that readers can share the file out.
    """
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(to, True)
    try:
        first, packed = (head + "\n").encode(), path.endswith(".gz")
        if packed:
            first = gzip.compress(first, mtime=0)
            first = members.header(first[: members.PLAIN], len(first)) + first[members.PLAIN :]
        out.write(bytearray(first))
        for part in parts:
            stream = fs.open(part.getPath())
            if packed:
                begin = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, members.PLAIN))
                out.write(bytearray(members.header(begin, part.getLen())))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()


def _csv(writer, path: str, packed: bool) -> None:
    writer.mode("overwrite").option("maxRecordsPerFile", MEMBER_ROWS).csv(
        path, sep="\t", header=False, compression="gzip" if packed else "none", quote="", emptyValue="", escape=""
    )


def write_table(df: DataFrame, path: str, order: list[Column] | None = None, formats: dict[str, str] | None = None) -> None:
    """A tab-separated table with a header as one file, in the order given; gzip if the name ends so.

    Ranges of rows are sorted, written and compressed by their tasks; the file is these put one after the other.
    """
    from ..operators.frames import in_ranges

    spark, names = df.sparkSession, [c for c in df.columns if c != "_row"]
    rows = in_ranges(df, order) if order else df
    _csv(rows.select(*_text(rows.select(*[F.col(f"`{c}`") for c in names]), formats or {})).write, f"{path}.parts", path.endswith(".gz"))
    _join_parts(spark, _parts(spark, f"{path}.parts"), "\t".join(names), path)
    remove(spark, f"{path}.parts")


def write_by_chromosome(df: DataFrame, prefix: str, suffix: str, order: str, chromosomes: list[int]) -> None:
    """The same for each chromosome, one gzip file (prefix, number, suffix), sorted by a column that isn't written; without rows just the header."""
    spark, folder = df.sparkSession, f"{prefix}.parts{suffix}"
    table = df.drop(order)
    rows = df.select(F.col("CHR").alias("chromosome"), *_text(table, {}), F.col(order).alias("_o"))
    rows = rows.repartition("chromosome").sortWithinPartitions("chromosome", "_o").drop("_o")
    _csv(rows.write.partitionBy("chromosome"), folder, True)
    for c in chromosomes:
        _join_parts(spark, _parts(spark, f"{folder}/chromosome={c}"), "\t".join(table.columns), f"{prefix}{c}{suffix}")
    remove(spark, folder)


def plain_number(x: float) -> str:
    """The shortest text of a number, without an exponent; whole numbers without a fraction."""
    if not math.isfinite(x):
        return {math.inf: "inf", -math.inf: "-inf"}.get(x, "NaN")
    text = format(Decimal(repr(float(x))), "f")
    return text[:-2] if text.endswith(".0") else text


def _m_line(row, names: list[str]) -> str:
    return "\t".join(plain_number(float(row[n] or 0.0)) for n in names) + "\n"


def write_m_by_chromosome(df: DataFrame, names: list[str], prefix: str, suffix: str) -> None:
    """A file for each row (prefix, CHR, suffix) with one line of tab-joined values."""
    for r in df.collect():  # rows are chromosomes
        write_text(df.sparkSession, _m_line(r, names), f"{prefix}{r['CHR']}{suffix}")


def write_m(df: DataFrame, names: list[str], path: str) -> None:
    """One line of tab-joined values out of a one-row table."""
    write_text(df.sparkSession, _m_line(df.first(), names), path)


def write_text(spark: SparkSession, text: str | bytes, path: str) -> None:
    """A small file, as one file and not a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode() if isinstance(text, str) else text))
    stream.close()


def cell_type_table(rows: list[dict]) -> str:
    """Lines of a cell-type result, P ascending, six decimals in exponent form."""
    out = ["Name\tCoefficient\tCoefficient_std_error\tCoefficient_P_value"]
    out += [f"{r['name']}\t{r['coefficient']:.6e}\t{r['coefficient_se']:.6e}\t{r['p']:.6e}" for r in sorted(rows, key=lambda r: r["p"])]
    return "\n".join(out) + "\n"


def overlap_table(rows: list[dict], coefficients: bool = False) -> str:
    """Lines of an overlap result, with seven columns or ten."""
    head = ["Category", "Prop._SNPs", "Prop._h2", "Prop._h2_std_error", "Enrichment", "Enrichment_std_error", "Enrichment_p"]
    if coefficients:
        head += ["Coefficient", "Coefficient_std_error", "Coefficient_z-score"]
    out = ["\t".join(head)]
    for r in rows:
        cells = [
            r["category"], *[f"{r[k]:.6f}" for k in ("prop_snps", "prop_h2", "prop_h2_se", "enrichment", "enrichment_se")],
            "NA" if r["enrichment_p"] is None else str(r["enrichment_p"])
        ]
        if coefficients:
            cells += [f"{r['coefficient']:.6e}", f"{r['coefficient_se']:.6e}", f"{r['coefficient_z']:.6f}"]
        out.append("\t".join(cells))
    return "\n".join(out) + "\n"


def category_table(fit) -> str:
    """Lines on the categories of a partitioned fit that don't overlap."""
    out = ["", f"{'Category':<35} {'Prop_h2':>10} {'Prop_SNPs':>10} {'Enrichment':>12} {'Coefficient':>14}", "-" * 83]
    for name, *cells, coef in zip(fit.names, fit.prop, fit.m / fit.m.sum(), fit.enrichment(), fit.coef):
        out.append(f"{name:<35} {cells[0]:>10.4f} {cells[1]:>10.4f} {cells[2]:>12.4f} {coef:>14.4e}")
    return "\n".join(out) + "\n\n"


def correlation_table(traits: list[str], found: list) -> str:
    """The summary of the first trait against each other; what is out of bounds stands as it is."""
    rows = [
        (
            traits[0], name, c.rg, c.se, c.z, c.p, c.h2.h2, c.h2.se, c.h2.intercept, c.h2.intercept_se, c.gencov.intercept,
            c.gencov.intercept_se
        ) for name,
        c in zip(traits[1:], found)
    ]
    head = ("p1", "p2", "rg", "se", "z", "p", "h2_obs", "h2_obs_se", "h2_int", "h2_int_se", "gcov_int", "gcov_int_se")
    wide = [max(2, *(len(r[k]) for r in rows)) for k in (0, 1)] if rows else [2, 2]
    wide += [8, 8, 8, 8, 8, 10, 8, 10, 9, 12]
    out = [" ".join(f"{c:>{w}}" for c, w in zip(head, wide))]
    out += [" ".join(f"{c if isinstance(c, str) else f'{c:.4f}':>{w}}" for c, w in zip(r, wide)) for r in rows]
    return "\nSummary of Genetic Correlation Results\n" + "\n".join(out) + "\n"


def ld_summary(summary: list, correlations: list, names: list[str], path: str) -> str:
    """Statistics of minor allele frequencies and LD scores, and their correlations, as tools that read them expect."""
    line = lambda label, cells: f"{label:>8}" + "".join(f"{c:>8}" if isinstance(c, str) else f"{c:>8.4f}" for c in cells)
    value = lambda x: math.nan if x is None else float(x)
    by = {r["column"]: r for r in summary}
    heads = ["MAF" if n == "maf" else n for n in names]
    out = ["", f"Summary of LD Scores in {path}", line("", heads)]
    for label, field in (("mean", "mean"), ("std", "sd"), ("min", "min"), ("25%", "q25"), ("50%", "median"), ("75%", "q75"), ("max", "max")):
        out.append(line(label, [value(by[n][field]) for n in names]))
    r = {(x["a"], x["b"]): value(x["r"]) for x in correlations}
    out += ["", "MAF/LD Score Correlation Matrix", line("", heads)]
    out += [line(head, [1.0 if a == b else r.get((a, b), r.get((b, a))) for b in names]) for head, a in zip(heads, names)]
    return "\n".join(out) + "\n"


def heritability_summary(h, fixed: bool, liability: float | None = None) -> str:
    """The lines that downstream tools parse."""
    out = [f"Total Observed scale h2: {h.h2:.4f} ({h.se:.4f})", f"Lambda GC: {h.lambda_gc:.4f}", f"Mean Chi^2: {h.mean_chi2:.4f}"]
    if fixed:
        out.append(f"Intercept: constrained to {h.intercept:.4f}")
    else:
        out.append(f"Intercept: {h.intercept:.4f} ({h.intercept_se:.4f})")
        if math.isnan(h.ratio):
            out.append("Ratio: NA (mean chi^2 < 1)")
        else:
            out.append("Ratio < 0 (usually indicates GC correction)." if h.ratio < 0 else f"Ratio: {h.ratio:.4f} ({h.ratio_se:.4f})")
    if liability is not None:
        out.append(f"Liability-scale h2: {h.h2 * liability:.4f}")
    return "\n".join(out) + "\n"


def covariance_summary(c, fixed: bool) -> str:
    last = f"Intercept: constrained to {c.intercept:.4f}" if fixed else f"Intercept: {c.intercept:.4f} ({c.intercept_se:.4f})"
    return f"Total Observed scale gencov: {c.rho:.4f} ({c.se:.4f})\nMean z1*z2: {c.mean_z1z2:.4f}\n{last}\n"


def correlation_summary(c) -> str:
    if c.status != "ok":
        why = "h2  out of bounds" if c.status.startswith("h2") else c.status
        return f"Genetic Correlation: nan (nan) ({why})\nZ-score: nan (nan) ({why})\nP: nan (nan) ({why})\n"
    return f"Genetic Correlation: {c.rg:.4f} ({c.se:.4f})\nZ-score: {c.z:.4f}\nP: {c.p:.4f}\n"


def delete_values(spark, jackknife) -> DataFrame:
    """(block, param, value) of a jackknife."""
    rows = [(b, p, float(v)) for b, row in enumerate(jackknife.delete) for p, v in enumerate(row)]
    return spark.createDataFrame(rows, "block int, param int, value double")
