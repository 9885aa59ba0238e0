"""Queries whose rows go through files: written below the shared folder by the writers, read again by the readers."""

from __future__ import annotations

import gzip

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames, ldscore, munging, windows
from ..sources import plink, readers, writers
from ..sources.shared import fresh_dir
from . import commands, memory, regression_sql
from .registry import _EXACT, _FILTERED, _REG, _Z, _reg, _row, _score_sql, query, r
from .views import Views


def _at(v: Views) -> str:
    return fresh_dir(v.spark, "files")


def _lines(df: DataFrame, path: str, order: str, *more: str) -> None:
    """Text lines (first column) in an order, after some more; small tables only."""
    rows = [x[0] for x in df.orderBy(order).select(df.columns[0]).collect()]
    writers.write_text(df.sparkSession, "".join(f"{x}\n" for x in [*more, *rows]), path)


# --- scans -------------------------------------------------------------------------------------------------------


@query("SELECT _row AS i, SNP, A1, A2, N, FRQ IS NULL AS no_frq FROM v_sumstats", "v_sumstats")
def scan_table(v: Views) -> DataFrame:
    """A gzip table in the order of its rows; empty cells are missing, numbers are numbers."""
    at = f"{_at(v)}.txt.gz"
    writers.write_table(v.ordered.select("SNP", "A1", "A2", "N", "FRQ", "_row"), at, [F.col("_row")])
    df = frames.numbered(readers.typed(readers.read_table(v.spark, at)), [F.col("_row")], "i")
    return df.select("i", "SNP", "A1", "A2", "N", F.col("FRQ").isNull().alias("no_frq"))


@query("SELECT row_number() OVER (ORDER BY CHR, num) - 1 AS i, CHR, SNP, round(L2, 3) AS L2 FROM v_ld", "v_ld")
def scan_chromosome_files(v: Views) -> DataFrame:
    at, ld = _at(v) + "/ld.", v.ld.select("CHR", "SNP", "L2", "num")
    writers.write_by_chromosome(ld, at, ".l2.ldscore.gz", "num", [x["CHR"] for x in ld.select("CHR").distinct().collect()])
    df = frames.numbered(readers.read_split(v.spark, at, ".l2.ldscore"), [F.col("_row")], "i")
    return df.select("i", F.col("CHR").cast("int").alias("CHR"), "SNP", F.col("L2").cast("double").alias("L2"))


@query(
    "SELECT CAST(count(*) AS DOUBLE) AS m, CAST(count(CASE WHEN maf > 0.05 THEN 1 END) AS DOUBLE) AS m_5_50, CAST(2 * count(*) AS "
    "DOUBLE) AS two FROM v_ld",
    "v_ld",
)
def m_sidecars(v: Views) -> DataFrame:
    at = _at(v) + "/ld."
    counts = ldscore.counts(v.ld.withColumns({"one": F.lit(1.0), "two": F.lit(2.0)}), ["one", "two"], ["CHR"])
    for kind in ("M", "M_5_50"):
        writers.write_m_by_chromosome(counts, [f"one_{kind}", f"two_{kind}"], at, f".l2.{kind}")
    both = readers.m_vector(v.spark, [at], True, False)
    return _row(v, m=readers.m_total(v.spark, at, False), m_5_50=readers.m_total(v.spark, at), two=both[1])


_BIM_LINE = "concat_ws('\t', CAST(CHR AS STRING), SNP, CAST(CM AS STRING), CAST(BP AS STRING), 'A', 'C')"


@query("SELECT CHR, SNP, round(CM, 6) AS CM, BP, row_number() OVER (ORDER BY num) - 1 AS bed_idx FROM v_bim QUALIFY CHR IN (1, 3, 22)", "v_bim")
def scan_bim(v: Views) -> DataFrame:
    at = _at(v) + ".bim"
    _lines(v.bim.select(F.expr(_BIM_LINE).alias("line"), "num"), at, "num")
    return readers.read_bim(v.spark, at, [1, 3, 22]).select("CHR", "SNP", r("CM").alias("CM"), "BP", "bed_idx")


@query('SELECT k AS iid_idx FROM (SELECT s_acctbal, row_number() OVER (ORDER BY "START") - 1 AS k FROM v_genes) WHERE s_acctbal > 0', "v_genes")
def scan_fam_keep(v: Views) -> DataFrame:
    at = _at(v)
    people = v.genes.select(
        F.concat_ws(" ", F.concat(F.lit("f"), "CHR"), "GENE", F.lit("0 0 1 -9")).alias("line"), "START", "s_acctbal", "CHR", "GENE"
    )
    _lines(people, f"{at}.fam", "START")
    listed = people.where("s_acctbal > 0").select(F.concat(F.lit("f"), "CHR", F.lit("\t"), "GENE").alias("line"), "START")
    _lines(listed, f"{at}.keep", "START", "# kept")
    kept = readers.keep_people(readers.read_fam(v.spark, f"{at}.fam"), readers.read_keep(v.spark, f"{at}.keep"))
    return v.spark.createDataFrame([(k,) for k in kept], "iid_idx long")


def _fileset(v: Views) -> tuple[str, bytes, str, int]:
    """(path, BED, BIM text, SNPs) of the genotypes, 64 people."""
    rows = v.geno.orderBy("CHR", "pos").collect()  # the table of the test has some thousand
    g = np.array([x["g"] for x in rows], np.int8)
    bed, at = plink.MAGIC + plink.encode_block(g), _at(v)
    bim = "".join(f"{x['CHR']}\t{x['SNP']}\t0\t{x['BP']}\tA\tC\n" for x in rows)
    writers.write_text(v.spark, bed, f"{at}.bed")
    writers.write_text(v.spark, bim, f"{at}.bim")
    writers.write_text(v.spark, "".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(64)), f"{at}.fam")
    return at, bed, bim, len(rows)


_GENOTYPES = "SELECT row_number() OVER (ORDER BY CHR, pos) - 1 AS bed_idx, array_to_string(list_transform({g}, lambda x: CAST(x AS VARCHAR)), '') AS g FROM v_geno"


@query(_GENOTYPES.replace("{g}", "[g[1], g[8], g[64], g[6]]"), "v_geno")
def scan_bed(v: Views) -> DataFrame:
    """Some people of a BED file, read by ranges of SNPs."""
    at, _, _, n = _fileset(v)
    return plink.read_bed(v.spark, f"{at}.bed", 64, n, [0, 7, 63, 5], 100).select(
        "bed_idx", F.array_join(F.col("g").cast("array<string>"), "").alias("g")
    )


@query(_GENOTYPES.replace("{g}", "g"), "v_geno")
def scan_bed_bytes(v: Views) -> DataFrame:
    _, bed, _, n = _fileset(v)
    return plink.from_bytes(v.spark, bed, 64, n).select("bed_idx", F.array_join(F.col("g").cast("array<string>"), "").alias("g"))


@query("SELECT SNP FROM v_ld WHERE num % 3 = 0", "v_ld")
def scan_snp_list(v: Views) -> DataFrame:
    at = _at(v) + ".snps"
    _lines(v.ld.where("num % 3 = 0").select("SNP", "num"), at, "num", "# SNPs", "")
    return v.ld.join(readers.read_snp_list(v.spark, at, True), "SNP", "left_semi").select("SNP")


@query("SELECT SNP, row_number() OVER (ORDER BY num) - 1 AS bed_idx, round(maf, 2) AS value FROM v_ld", "v_ld")
def scan_cts(v: Views) -> DataFrame:
    """Values of a continuous annotation beside the BIM's SNPs."""
    at = _at(v)
    _lines(v.ld.select(F.expr("concat_ws('\t', '1', SNP, '0', CAST(num AS STRING), 'A', 'C')").alias("line"), "num"), f"{at}.bim", "num")
    _lines(v.ld.select(F.expr("concat(SNP, '  ', CAST(maf AS STRING))").alias("line"), "num"), f"{at}.cts", "num")
    return readers.read_cts(
        v.spark, f"{at}.cts", readers.read_bim(v.spark, f"{at}.bim").select("SNP", "bed_idx")
    ).select("SNP", "bed_idx", r("value", 2).alias("value"))


@query(
    "SELECT row_number() OVER (ORDER BY CAST(substr(SNP, 3) AS BIGINT)) - 1 AS i, CAST(base AS DOUBLE) AS base, CAST(coding AS "
    "DOUBLE) AS coding, CAST(enh AS DOUBLE) AS enh, FRQ > 0.05 AND FRQ < 0.95 AS common FROM v_annot",
    "v_annot",
)
def scan_annotation_and_frequencies(v: Views) -> DataFrame:
    at, num = _at(v), F.substring("SNP", 3, 20).cast("long")
    writers.write_table(
        v.annot.select(F.lit(1).alias("CHR"), num.alias("BP"), "SNP", F.lit(0).alias("CM"), "base", "coding", "enh"), f"{at}.annot.gz",
        [F.col("BP")]
    )
    writers.write_table(v.annot.select("SNP", F.col("FRQ").alias("MAF"), num.alias("n")), f"{at}.frq", [F.col("n")])
    annot, names = readers.read_annotation(v.spark, readers.annotation_path(v.spark, at))
    left = frames.numbered(annot, [F.col("_row")], "i")
    right = frames.numbered(readers.read_frequencies(v.spark, f"{at}.frq"), [F.col("_row")], "i")
    return left.join(right.select("i", "common"), "i").select("i", *names, "common")


@query("SELECT CHR, s, e FROM v_intervals", "v_intervals")
def scan_regions(v: Views) -> DataFrame:
    at = _at(v) + ".bed"
    rows = v.intervals.select(F.concat(F.lit("chr"), F.col("CHR").cast("string")).alias("#chrom"), "s", F.col("e").cast("string").alias("e"))
    writers.write_table(rows.withColumn("s", F.col("s").cast("string")), at)
    return readers.read_regions(v.spark, at)


@query('SELECT GENE, CHR, "START", "END" FROM v_genes WHERE s_acctbal > 0', "v_genes")
def scan_genes(v: Views) -> DataFrame:
    at = _at(v)
    _lines(v.genes.where("s_acctbal > 0").select("GENE", "START"), f"{at}.set", "START", "# genes")
    _lines(
        v.genes.select(
            F.expr("concat_ws(' ', GENE, concat('chr', CAST(CHR AS STRING)), CAST(START AS STRING), CAST(END AS STRING))").alias("line"),
            "START"
        ),
        f"{at}.coord", "START", "GENE CHR START END"
    )
    return readers.read_gene_coordinates(v.spark, f"{at}.coord", readers.read_genes(v.spark, f"{at}.set"))


@query('SELECT GENE, CHR, row_number() OVER (ORDER BY "START") - 1 AS i FROM v_genes', "v_genes")
def decode_memory(v: Views) -> DataFrame:
    """A gzip table whose bytes are in memory."""
    rows = v.genes.orderBy("START").collect()
    data = gzip.compress(("GENE CHR\n" + "".join(f"{x['GENE']} {x['CHR']}\n" for x in rows)).encode())
    return readers.decode_table(v.spark, data).select("GENE", F.col("CHR").cast("int").alias("CHR"), F.col("_row").alias("i"))


@query(
    "SELECT concat_ws(':', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), upper(A1), upper(A2)) AS SNP, "
    "round(greatest(least(power(10, -l_quantity), 1), 1e-300) * 1e9, 3) AS P_e9, round(BETA, 6) AS BETA, round(SE, 6) AS SE FROM "
    "(SELECT s.*, l_partkey, l_suppkey, l_quantity FROM v_sumstats s JOIN (SELECT row_number() OVER (ORDER BY l_orderkey, "
    "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) "
    "- 1 AS _row, l_partkey, l_suppkey, l_quantity FROM lineitem) USING (_row)) WHERE _row < 1000 AND FRQ IS NOT NULL",
    "v_sumstats",
)
def biobank_prep(v: Views) -> DataFrame:
    """Columns of one population of a biobank's file; rows of low confidence go."""
    df = v._view("v_sumstats").withColumn(
        "_row",
        F.struct(
            *[
                F.col(c) for c in (
                    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "l_returnflag", "l_linestatus", "l_shipdate"
                )
            ]
        )
    )
    df = frames.numbered(df, [F.col("_row")], "_i").where("_i < 1000")
    text = df.select(
        F.col("l_partkey").alias("chr"), F.col("l_suppkey").alias("pos"), F.upper("A1").alias("ref"), F.upper("A2").alias("alt"),
        F.col("l_quantity").cast("string").alias("neglog10_pval_EUR"), F.col("BETA").cast("string").alias("beta_EUR"),
        F.col("SE").cast("string").alias("se_EUR"), F.col("FRQ").isNull().cast("string").alias("low_confidence_EUR"), "_row"
    )
    got = readers.biobank_sumstats(text, "EUR")
    return got.select("SNP", r(F.col("P") * 1e9, 3).alias("P_e9"), r("BETA").alias("BETA"), r("SE").alias("SE"))


# --- frames --------------------------------------------------------------------------------------------------------


@query("SELECT SNP, round(L2, 6) AS score, round(maf, 6) AS maf, num AS _row FROM v_ld", "v_ld")
def columns_beside_columns(v: Views) -> DataFrame:
    left = frames.rename(frames.select(v.ld, ["SNP", "L2", "num"]), {"L2": "score", "num": "_row"})
    right = frames.select(v.ld.withColumn("_row", F.col("num")), ["maf", "_row"])
    return frames.side_by_side(left, right).select("SNP", r("score").alias("score"), r("maf").alias("maf"), "_row")


@query("SELECT a.num AS _row, b.SNP FROM v_ld a JOIN v_ld b ON b.num = a.num * 3 % 100 + 1", "v_ld")
def take_rows(v: Views) -> DataFrame:
    places = v.ld.select((F.pmod(F.col("num") * 3, F.lit(100)) + 1).alias("at"), F.col("num").alias("_to"))
    return frames.take_rows(v.ld.select("SNP", F.col("num").alias("_row")), places).select("_row", "SNP")


@query("SELECT SNP, round(L2, 6) AS L2 FROM v_ld", "v_ld")
def drop_constant(v: Views) -> DataFrame:
    df, kept = frames.drop_constant(v.ld.select("SNP", "L2").withColumn("same", F.lit(2.0)), ["L2", "same"])
    return df.select("SNP", *[r(c).alias(c) for c in kept])


@query("SELECT CHR, count(*) AS n FROM v_bim GROUP BY CHR", "v_bim")
def chromosome_counts(v: Views) -> DataFrame:
    return memory.chromosome_counts(v.bim)


@query(
    "SELECT SNP, max(first) OVER (ORDER BY k) AS run FROM (SELECT SNP, k, CASE WHEN lag(CHR) OVER (ORDER BY k) IS DISTINCT FROM "
    "CHR THEN k END AS first FROM (SELECT *, row_number() OVER (ORDER BY num) - 1 AS k FROM v_bim))",
    "v_bim",
)
def chromosome_runs(v: Views) -> DataFrame:
    """The table isn't sorted by chromosome."""
    return windows.chromosome_runs(frames.numbered(v.bim, [F.col("num")], "bed_idx")).select("SNP", "run")


# --- munging -------------------------------------------------------------------------------------------------------

_MUNGED = f"{_FILTERED}, z AS (SELECT SNP, A1, A2, {_Z} AS Z, N, FRQ, _row FROM ok), first AS (SELECT *, row_number() OVER (PARTITION BY SNP ORDER BY _row) AS k FROM z WHERE Z IS NOT NULL)"


@query(f"{_MUNGED} SELECT SNP, A1, A2, round(Z, 6) AS Z, round(N, 6) AS N, round(FRQ, 6) AS FRQ FROM first WHERE k = 1", "v_sumstats")
def munge_other_names(v: Views) -> DataFrame:
    """Headers of other studies: synonyms, a column given by name, one ignored, a sign given by name and null value."""
    raw = v.ordered.drop("N_CAS", "N_CON", "NSTUDY")
    raw = raw.withColumnsRenamed(
        {"SNP": "MarkerName", "A1": "effect_allele", "A2": "Other_Allele", "BETA": "tstat", "P": "p_value", "FRQ": "eaf", "INFO": "quality"}
    ).withColumn("junk", F.lit(None).cast("string"))
    opts = munging.MungeOptions(columns={"INFO": "quality"}, signed_sumstats="tstat,0", ignore=("JUNK", "se"), keep_maf=True)
    return munging.munge(raw, opts).select("SNP", "A1", "A2", r("Z").alias("Z"), r("N").alias("N"), r("FRQ").alias("FRQ"))


_DANER = f"""WITH p AS (SELECT * FROM v_sumstats WHERE P > 0 AND P <= 1 AND FRQ BETWEEN 0 AND 1 AND least(FRQ, 1 - FRQ) > 0.01),
    z AS (SELECT SNP, {_Z.replace("BETA", "1")} AS Z, row_number() OVER (PARTITION BY SNP ORDER BY _row) AS k FROM p)
    SELECT SNP, round(Z, 6) AS Z, CAST(5500 AS DOUBLE) AS N FROM z WHERE k = 1"""


@query(_DANER, "v_sumstats")
def munge_daner(v: Views) -> DataFrame:
    """Counts in the headers, no alleles wanted, the first allele raises the risk."""
    raw = v.ordered.select("SNP", "P", "FRQ", "_row").withColumn("FRQ_A_2500", F.lit(0.5)).withColumnRenamed("FRQ", "FRQ_U_3000")
    return munging.munge(raw, munging.MungeOptions(daner=True, no_alleles=True, a1_inc=True)).select("SNP", r("Z").alias("Z"), "N")


_TEXT = _MUNGED.replace("v_sumstats", "v_text").replace(
    "WITH p AS",
    "WITH v_text AS (SELECT SNP, A1, A2, round(BETA, 3) AS BETA, round(SE, 3) AS SE, round(P, 3) AS P, N, round(INFO, 3) AS INFO, round(FRQ, 3) AS FRQ, _row FROM v_sumstats), p AS",
    1
)


@query(f"{_TEXT} SELECT SNP, A1, A2, round(Z, 3) + 0.0 AS Z, N, row_number() OVER (ORDER BY _row) - 1 AS i FROM first WHERE k = 1", "v_sumstats")
def munge_files(v: Views) -> DataFrame:
    """The command: a raw table is read, munged and written in its order; the written file is read again."""
    at = _at(v)
    writers.write_table(v.ordered.drop("N_CAS", "N_CON", "NSTUDY"), f"{at}.raw.gz", [F.col("_row")])
    commands.run_munge(v.spark, f"{at}.raw.gz", at)
    done = frames.numbered(readers.read_sumstats(v.spark, f"{at}.sumstats.gz"), [F.col("_row")], "i")
    return done.select("SNP", "A1", "A2", (F.col("Z").cast("double") + 0.0).alias("Z"), F.col("N").cast("double").alias("N"), "i")


# --- commands --------------------------------------------------------------------------------------------------------

_BY_SNP = _score_sql(_EXACT, {"L2": "CASE WHEN @.pos >= 0 THEN 1 END"}).replace("SELECT m.CHR, m.pos,", "SELECT m.CHR, any_value(m.SNP) AS SNP,")


@query(_BY_SNP, "v_geno")
def l2_from_bytes(v: Views) -> DataFrame:
    _, bed, bim, _ = _fileset(v)
    return memory.l2_from_bytes(v.spark, bed, bim, 64, kb=200, chunk=None).select("CHR", "SNP", r("L2", 5).alias("L2"))


@query(_BY_SNP.replace(", 5) AS L2", ", 3) AS L2"), "v_geno")
def l2_files(v: Views) -> DataFrame:
    """The command over a fileset; the chromosome files that it wrote are read again, to their three decimals."""
    at, _, _, _ = _fileset(v)
    commands.run_l2(v.spark, at, f"{at}.out", commands.LdOptions(kb=200, snp_level_masking=True, yes_really=True))
    df = readers.read_split(v.spark, f"{at}.out", ".l2.ldscore", every=True)
    return df.select(F.col("CHR").cast("int").alias("CHR"), "SNP", F.col("L2").cast("double").alias("L2"))


_REG_TEXT = _REG.replace(
    "f.Z, f.Z * f.Z AS chi2", "round(f.Z, 3) AS Z, round(f.Z, 3) * round(f.Z, 3) AS chi2"
).replace("l.L2,", "round(l.L2, 3) AS L2,").replace("l.w_l2,", "round(l.w_l2, 3) AS w_l2,")


@query(regression_sql.two_step(_REG_TEXT), "v_sumstats", "v_ld")
def h2_files(v: Views) -> DataFrame:
    """The command in two steps over files of summary statistics, LD scores by chromosome and weights."""
    at, reg = _at(v), _reg(v)
    writers.write_table(reg.select("SNP", "Z", "N", "_i"), f"{at}.sumstats.gz", [F.col("_i")])
    chromosomes = [x["CHR"] for x in v.ld.select("CHR").distinct().collect()]
    writers.write_by_chromosome(v.ld.select("CHR", "SNP", "L2", "num"), f"{at}.ref.", ".l2.ldscore.gz", "num", chromosomes)
    writers.write_by_chromosome(v.ld.select("CHR", "SNP", F.col("w_l2").alias("L2"), "num"), f"{at}.w.", ".l2.ldscore.gz", "num", chromosomes)
    h, _ = commands.run_h2(v.spark, f"{at}.sumstats.gz", f"{at}.ref.", f"{at}.w.", None, commands.RegressionOptions(m=1000.0), True)
    found = {
        "h2": h.h2, "h2_se": h.se, "intercept": h.intercept, "intercept_se": h.intercept_se, "mean_chi2": h.mean_chi2,
        "lambda_gc": h.lambda_gc, "ratio": h.ratio, "ratio_se": h.ratio_se
    }
    return _row(v, **{k: round(x, 5) for k, x in found.items()})
