"""All queries of the engine itself and their SQL for the oracle. Floats are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import annotations, frames, ldscore, munging, sketch, windows
from ..sources import plink
from ..stats import regression
from . import regression_sql
from .views import Views, oracle_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query over ``Views`` with its SQL; the named views come as common table expressions."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            head = ", ".join(f"{v} AS ({oracle_view(v)})" for v in views)
            body = sql.strip()
            ORACLE[f.__name__] = f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
        return f

    return register


def r(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- munging ---------------------------------------------------------------------------------------------------

_VALID = "A1 IN ('A','C','G','T') AND A2 IN ('A','C','G','T') AND A1 <> A2 AND A1 || A2 NOT IN ('AT','TA','CG','GC')"
_IN_RANGE = "SELECT * FROM v_sumstats WHERE P > 0 AND P <= 1"
_FILTERED = f"""WITH p AS ({_IN_RANGE}), q AS (SELECT quantile_cont(N, 0.9) / 1.5 AS least FROM p),
    kept AS (SELECT SNP, upper(A1) AS A1, upper(A2) AS A2, BETA, SE, P, N, INFO, FRQ, _row FROM p, q WHERE N >= least AND FRQ BETWEEN 0 AND 1 AND least(FRQ, 1 - FRQ) > 0.01 AND INFO >= 0.9),
    ok AS (SELECT * FROM kept WHERE {_VALID})"""
_Z = f"CASE WHEN BETA > 0 THEN {C.probit_sql('P')} WHEN BETA < 0 THEN -({C.probit_sql('P')}) END"


def _filtered(v: Views) -> DataFrame:
    df = munging.n_at_least(munging.p_in_range(v.sumstats), 0)
    return munging.alleles_valid(munging.info_at_least(munging.frequency_above(df, 0.01), 0.9))


@query(f"{_FILTERED} SELECT SNP, A1, A2, round(N, 6) AS N, round(FRQ, 6) AS FRQ, round(INFO, 6) AS INFO, _row FROM ok", "v_sumstats")
def munge_filters(v: Views) -> DataFrame:
    return _filtered(v).select("SNP", "A1", "A2", r("N").alias("N"), r("FRQ").alias("FRQ"), r("INFO").alias("INFO"), "_row")


@query(
    f"{_FILTERED}, z AS (SELECT SNP, A1, A2, {_Z} AS Z, N, _row FROM ok), first AS (SELECT *, row_number() OVER (PARTITION BY SNP "
    f"ORDER BY _row) AS k FROM z WHERE Z IS NOT NULL) SELECT SNP, A1, A2, round(Z, 6) AS Z, round(N, 6) AS N FROM first WHERE k = 1",
    "v_sumstats",
)
def munge_z(v: Views) -> DataFrame:
    raw = v.ordered.drop("N_CAS", "N_CON", "NSTUDY")
    return munging.munge(raw).select("SNP", "A1", "A2", r("Z").alias("Z"), r("N").alias("N"))


@query(
    f"WITH q AS (SELECT quantile_cont(N, 0.9) / 1.5 AS least FROM ({_IN_RANGE})) SELECT SNP, N, _row FROM ({_IN_RANGE}), q WHERE N "
    f">= least",
    "v_sumstats",
)
def munge_n_min(v: Views) -> DataFrame:
    return munging.n_at_least(munging.p_in_range(v.sumstats), 0).select("SNP", "N", "_row")


@query(
    "WITH t AS (SELECT max(N_CAS + N_CON) AS top FROM v_sumstats), s AS (SELECT avg(N_CAS / (N_CAS + N_CON)) AS share FROM "
    "v_sumstats, t WHERE N_CAS + N_CON = top) SELECT _row, round(N_CAS / share, 6) AS N FROM v_sumstats, s",
    "v_sumstats",
)
def munge_n_case_control(v: Views) -> DataFrame:
    return munging.sample_size(v.sumstats.drop("N"), None, None, None).select("_row", r("N").alias("N"))


@query("SELECT _row, round((INFO + FRQ) / 2, 6) AS INFO FROM v_sumstats", "v_sumstats")
def munge_info_list(v: Views) -> DataFrame:
    return munging.info_mean(v.sumstats, ("info", "frq")).select("_row", r("INFO").alias("INFO"))


@query("SELECT _row, SNP FROM v_sumstats WHERE FRQ IS NOT NULL", "v_sumstats")
def munge_drop_missing(v: Views) -> DataFrame:
    return munging.drop_missing(v.sumstats.withColumn("INFO", F.lit(None).cast("double"))).select("_row", "SNP")


@query("SELECT _row, SNP, NSTUDY FROM v_sumstats WHERE NSTUDY >= 4", "v_sumstats")
def munge_nstudy(v: Views) -> DataFrame:
    return munging.studies_at_least(v.sumstats, "nstudy", 4).select("_row", "SNP", "NSTUDY")


@query("SELECT _row, round(BETA / SE, 6) AS Z FROM v_sumstats", "v_sumstats")
def munge_z_from_beta(v: Views) -> DataFrame:
    return munging.derive_z(v.sumstats.drop("P")).select("_row", r("Z").alias("Z"))


_SIGN = """CASE WHEN a.A1 = b.A1 AND a.A2 = b.A2 OR translate(a.A1, 'ACGT', 'TGCA') = b.A1 AND translate(a.A2, 'ACGT', 'TGCA') = b.A2 THEN 1
    WHEN a.A1 = b.A2 AND a.A2 = b.A1 OR translate(a.A1, 'ACGT', 'TGCA') = b.A2 AND translate(a.A2, 'ACGT', 'TGCA') = b.A1 THEN -1 END"""


@query(
    f"WITH a AS (SELECT SNP, upper(A1) AS A1, upper(A2) AS A2, _row FROM v_sumstats) SELECT a.SNP, a.A1, a.A2, a._row FROM a JOIN "
    f"v_alleles b ON a.SNP = b.SNP WHERE {_SIGN} IS NOT NULL",
    "v_sumstats", "v_alleles",
)
def munge_merge_alleles(v: Views) -> DataFrame:
    up = v.sumstats.withColumns({"A1": F.upper("A1"), "A2": F.upper("A2")})
    return munging.merge_alleles(up, v.alleles).select("SNP", "A1", "A2", "_row")


@query(
    f"WITH a AS (SELECT SNP, upper(A1) AS A1, upper(A2) AS A2, BETA, _row FROM v_sumstats), s AS (SELECT a.*, {_SIGN} AS sign FROM "
    f"a JOIN v_alleles b ON a.SNP = b.SNP WHERE {_VALID.replace('A1', 'a.A1').replace('A2', 'a.A2')}) SELECT SNP, _row, round(BETA "
    f"* sign, 6) + 0.0 AS Z2 FROM s WHERE sign IS NOT NULL",
    "v_sumstats", "v_alleles",
)
def rg_align(v: Views) -> DataFrame:
    up = munging.alleles_valid(v.sumstats)
    met = up.join(v.alleles.toDF("SNP", "_b1", "_b2"), "SNP").withColumn(
        "sign", C.same_or_flipped(F.col("A1"), F.col("A2"), F.col("_b1"), F.col("_b2"))
    )
    return met.where("sign IS NOT NULL").select("SNP", "_row", (r(F.col("BETA") * F.col("sign")) + 0.0).alias("Z2"))


@query(
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY SNP ORDER BY _row) AS k FROM v_sumstats) SELECT SNP, A1, A2, _row FROM "
    "f WHERE k = 1",
    "v_sumstats",
)
def dedup_first(v: Views) -> DataFrame:
    return frames.first_of(v.sumstats_of("SNP", "A1", "A2"), ["SNP"], [F.col("_row")]).select("SNP", "A1", "A2", "_row")


@query(
    "SELECT SNP, _row, CASE WHEN FRQ IS NULL THEN '' ELSE CASE WHEN regexp_matches(printf('%.3f', FRQ), '0+$') THEN "
    "regexp_replace(regexp_replace(printf('%.3f', FRQ), '0+$', ''), '\\.$', '.0') ELSE printf('%.3f', FRQ) END END AS FRQ FROM "
    "v_sumstats",
    "v_sumstats",
)
def float_format(v: Views) -> DataFrame:
    """As numbers are written to tables."""
    return v.sumstats.select("SNP", "_row", C.float_text(F.col("FRQ")).alias("FRQ"))


# --- joins and regression inputs ---------------------------------------------------------------------------------

_REG = f"""WITH z AS (SELECT SNP, {_Z} AS Z, N, _row FROM v_sumstats WHERE P > 0 AND P <= 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY SNP ORDER BY _row) AS k FROM z WHERE Z IS NOT NULL),
    reg AS (SELECT f.SNP, f.Z, f.Z * f.Z AS chi2, f.N, l.L2, l.codingL2, l.w_l2, row_number() OVER (ORDER BY f._row) - 1 AS _i FROM f JOIN v_ld l ON f.SNP = l.SNP WHERE k = 1)"""


def _reg(v: Views) -> DataFrame:
    """One row for each SNP in file order: Z, chi2, N, LD scores, weight, position, number of all."""
    sumstats = munging.p_in_range(v.ordered)
    first = frames.first_of(sumstats.where(munging.has_z(sumstats)).select("SNP", "BETA", "P", "N", "_row"), ["SNP"], [F.col("_row")])
    joined = frames.join_first(first, v.ld.select("SNP", "L2", "codingL2", "w_l2"), "SNP", [F.struct("L2", "w_l2")])
    rows = frames.numbered(joined, [F.col("_row")], "_i", total="_n").drop("_row")
    return munging.derive_z(rows).withColumn("chi2", C.chi_square(F.col("Z"))).drop("BETA", "P")


def regressed(v: Views, fit, prepare=lambda df: df):
    """``fit`` of the regression table, which is read in several passes and so kept for them."""
    reg = prepare(_reg(v)).persist()
    try:
        return fit(reg)
    finally:
        reg.unpersist()


@query(f"{_REG} SELECT SNP, round(chi2, 5) AS chi2, N, round(L2, 6) AS L2, round(w_l2, 6) AS w_l2, _i FROM reg", "v_sumstats", "v_ld")
def sumstats_ld_join(v: Views) -> DataFrame:
    return _reg(v).select("SNP", r("chi2", 5).alias("chi2"), "N", r("L2").alias("L2"), r("w_l2").alias("w_l2"), "_i")


_N, _B = "(SELECT count(*) FROM reg)", 50


@query(f"{_REG} SELECT SNP, CAST(((_i + 1) * {_B} - 1) // {_N} AS BIGINT) AS block FROM reg", "v_sumstats", "v_ld")
def jackknife_blocks(v: Views) -> DataFrame:
    return _reg(v).select("SNP", regression.block_of(F.col("_i"), F.col("_n"), _B).alias("block"))


_W = "1 / (2 * power(1 + 0.5 * N / 1000 * greatest(L2, 1), 2)) / greatest(w_l2, 1)"


@query(f"{_REG} SELECT SNP, round({_W}, 9) AS w FROM reg", "v_sumstats", "v_ld")
def regression_weights(v: Views) -> DataFrame:
    w = C.regression_weight(F.col("L2"), F.col("w_l2"), F.col("N"), 1000, 0.5, 1)
    return _reg(v).select("SNP", r(w, 9).alias("w"))


@query(
    f"{_REG} SELECT SNP, round(1 / ((N * 0.5 * greatest(L2, 1) / 1000 + 1) * (2 * N * 0.25 * greatest(L2, 1) / 1000 + 1.1) + "
    f"power(sqrt(2 * N * N) * 0.3 * greatest(L2, 1) / 1000 + 0.05, 2)) / greatest(w_l2, 1), 9) AS w FROM reg",
    "v_sumstats", "v_ld",
)
def gencov_weights(v: Views) -> DataFrame:
    w = C.covariance_weight(F.col("L2"), F.col("w_l2"), F.col("N"), 2 * F.col("N"), 1000, 0.5, 0.25, 0.3, 0.05, 1, 1.1)
    return _reg(v).select("SNP", r(w, 9).alias("w"))


@query(f"{_REG} SELECT round(1000 * (avg(chi2) - 1) / avg(L2 * N), 6) AS h2 FROM reg", "v_sumstats", "v_ld")
def aggregate_h2(v: Views) -> DataFrame:
    return _reg(v).agg(r(1000 * (F.avg("chi2") - 1) / F.avg(F.col("L2") * F.col("N"))).alias("h2"))


@query(f"{_REG} SELECT round(median(chi2) / 0.4549, 6) AS lambda_gc, round(avg(chi2), 6) AS mean_chi2, count(*) AS n FROM reg", "v_sumstats", "v_ld")
def lambda_gc(v: Views) -> DataFrame:
    return _reg(v).agg(r(F.median("chi2") / regression.MEDIAN_CHI2).alias("lambda_gc"), r(F.avg("chi2")).alias("mean_chi2"), F.count("*").alias("n"))


@query(
    f"{_REG}, c AS (SELECT greatest(0.001 * max(N), 80) AS top FROM reg) SELECT SNP, round(chi2, 5) AS chi2 FROM reg, c WHERE chi2 "
    f"< least(top, 2)",
    "v_sumstats", "v_ld",
)
def chisq_max(v: Views) -> DataFrame:
    reg = _reg(v)
    top = reg.agg(F.greatest(0.001 * F.max("N"), F.lit(80.0)).alias("top"))
    return reg.join(F.broadcast(top)).where(F.col("chi2") < F.least("top", F.lit(2.0))).select("SNP", r("chi2", 5).alias("chi2"))


@query(
    f"{_REG} SELECT CAST(((_i + 1) * {_B} - 1) // {_N} AS BIGINT) AS block, count(*) AS n, round(sum({_W} * L2 * L2), 5) AS xx, "
    f"round(sum({_W} * L2), 6) AS x1, round(sum({_W}), 7) AS s, round(sum({_W} * L2 * chi2), 5) AS xy FROM reg GROUP BY 1",
    "v_sumstats", "v_ld",
)
def block_gram(v: Views) -> DataFrame:
    reg = _reg(v)
    w = C.regression_weight(F.col("L2"), F.col("w_l2"), F.col("N"), 1000, 0.5, 1)
    sums = regression.block_sums(reg, [F.col("L2"), F.lit(1.0)], F.col("chi2"), w, regression.block_of(F.col("_i"), F.col("_n"), _B))
    return sums.select("block", "n", r("xx_0_0", 5).alias("xx"), r("xx_0_1").alias("x1"), r("xx_1_1", 7).alias("s"), r("xy_0", 5).alias("xy"))


def _one_step(fixed: bool) -> str:
    """The regression with two rounds of new weights as SQL: closed 2 x 2 (or 1 x 1) solutions."""
    w = lambda h, a: f"1 / (2 * power({a} + least(greatest({h}, 0), 1) * N / 1000 * greatest(L2, 1), 2)) / greatest(w_l2, 1)"
    text = f"{_REG}, a AS (SELECT avg(N) AS nb, 1000 * (avg(chi2) - 1) / avg(L2 * N) AS h, CAST(1 AS DOUBLE) AS i FROM reg)"
    for k in range(3):
        last = "a" if k == 0 else f"e{k - 1}"
        text += f", s{k} AS (SELECT any_value(nb) AS nb, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * chi2) AS sy, sum(w * x * chi2) AS sxy FROM (SELECT chi2, N * L2 / nb AS x, nb, {w('h', 'i')} AS w FROM reg, {last}))"
        if fixed:
            text += f", e{k} AS (SELECT nb, 1000 * (sxy - sx) / sxx / nb AS h, CAST(1 AS DOUBLE) AS i FROM s{k})"
        else:
            text += f", e{k} AS (SELECT nb, 1000 * (s * sxy - sx * sy) / (s * sxx - sx * sx) / nb AS h, (sxx * sy - sx * sxy) / (s * sxx - sx * sx) AS i FROM s{k})"
    return text + " SELECT round(h, 5) AS h2, round(i, 5) AS intercept FROM e2"


def _row(v: Views, **values: float) -> DataFrame:
    fine = [(k, float(x)) for k, x in values.items()]
    return v.spark.range(1).select(*[F.lit(x if np.isfinite(x) else None).cast("double").alias(k) for k, x in fine])


@query(_one_step(False), "v_sumstats", "v_ld")
def h2_one_step(v: Views) -> DataFrame:
    h = regressed(v, lambda reg: regression.heritability(reg, ["L2"], [1000.0]))
    return _row(v, h2=round(h.h2, 5), intercept=round(h.intercept, 5))


@query(_one_step(True), "v_sumstats", "v_ld")
def h2_fixed_intercept(v: Views) -> DataFrame:
    h = regressed(v, lambda reg: regression.heritability(reg, ["L2"], [1000.0], intercept=1.0))
    return _row(v, h2=round(h.h2, 5), intercept=1.0)


@query(regression_sql.two_step(_REG), "v_sumstats", "v_ld")
def h2_two_step(v: Views) -> DataFrame:
    h = regressed(v, lambda reg: regression.heritability(reg, ["L2"], [1000.0], step=30.0))
    found = {
        "h2": h.h2, "h2_se": h.se, "intercept": h.intercept, "intercept_se": h.intercept_se, "mean_chi2": h.mean_chi2,
        "lambda_gc": h.lambda_gc, "ratio": h.ratio, "ratio_se": h.ratio_se
    }
    return _row(v, **{k: round(x, 5) for k, x in found.items()})


@query(regression_sql.categories(_REG), "v_sumstats", "v_ld")
def h2_partitioned(v: Views) -> DataFrame:
    fit = regressed(v, lambda reg: regression.partitioned(reg, ["L2", "codingL2"], [1000.0, 400.0]))
    rows = [
        (n, round(float(a), 5), round(float(b), 5), round(1000 * float(c), 7), round(1000 * float(d), 7)) for n, a, b, c,
        d in zip(fit.names, fit.prop, fit.enrichment(), fit.coef, fit.coef_se)
    ]
    return v.spark.createDataFrame(rows, "category string, prop_h2 double, enrichment double, coefficient_1000 double, coefficient_se_1000 double")


@query(regression_sql.overlapping(_REG), "v_sumstats", "v_ld", "v_annot")
def h2_overlap(v: Views) -> DataFrame:
    """Without the P values, whose distribution has no SQL."""
    got = {(x["a"], x["b"]): x["value"] for x in annotations.overlap(v.annot, ["base", "coding"]).collect()}
    matrix = np.array([[got[a, b] for b in ("base", "coding")] for a in ("base", "coding")])
    total = v.annot.count()
    fit = regressed(v, lambda reg: regression.partitioned(reg, ["L2", "codingL2"], [float(matrix[0, 0]), float(matrix[1, 1])]))
    five = ("prop_h2", "prop_h2_se", "enrichment", "enrichment_se")
    rows = [
        (
            x["category"], round(x["prop_snps"], 6), *(round(x[k], 5) for k in five), round(1000 * x["coefficient"], 7),
            round(1000 * x["coefficient_se"], 7), round(x["coefficient_z"], 5)
        ) for x in regression.overlap_results(fit, matrix, total)
    ]
    return v.spark.createDataFrame(
        rows,
        "category string, prop_snps double, " + ", ".join(f"{c} double" for c in five) + ", coefficient_1000 double, coefficient_se_1000 double, coefficient_z double"
    )


@query(regression_sql.cell_types(_REG), "v_sumstats", "v_ld")
def h2_cell_type(v: Views) -> DataFrame:
    """Without the P values, whose distribution has no SQL."""
    tissue = lambda reg: reg.withColumn("tissueL2", F.col("codingL2") * F.pmod("_i", F.lit(3)))
    sets = [("coding", ["codingL2"], [400.0]), ("tissue", ["tissueL2"], [300.0])]
    rows = regressed(v, lambda reg: regression.cell_types(reg, sets, ["L2"], [1000.0]), tissue)
    return v.spark.createDataFrame(
        [(x["name"], round(1000 * x["coefficient"], 7), round(1000 * x["coefficient_se"], 7)) for x in rows],
        "name string, coefficient_1000 double, coefficient_se_1000 double"
    )


def _two_traits(reg: DataFrame) -> DataFrame:
    """A trait that follows the LD scores, and a second one that keeps part of its signal."""
    first = F.col("Z") * F.sqrt(1 + F.col("L2") / 5)
    second = (0.6 * first + F.sin(F.col("_i"))).alias("Z2")
    return reg.select("_i", first.alias("Z1"), second, F.col("N").alias("N1"), (F.col("N") + 100).alias("N2"), "L2", "w_l2")


@query(regression_sql.correlation(_REG), "v_sumstats", "v_ld")
def rg_pair(v: Views) -> DataFrame:
    """Without the P value, whose distribution has no SQL."""
    c = regressed(v, lambda reg: regression.correlation(reg, ["L2"], [1000.0]), _two_traits)
    found = {
        "rg": c.rg, "se": c.se, "h2_1": c.h1.h2, "h2_2": c.h2.h2, "gcov": c.gencov.rho, "gcov_int": c.gencov.intercept,
        "mean_z1z2": c.gencov.mean_z1z2
    }
    return _row(v, **{k: round(x, 5) for k, x in found.items()}, z=round(c.z, 4))


# --- LD scores ---------------------------------------------------------------------------------------------------

_STD = """WITH st AS (SELECT *, list_sum(g) / 64.0 AS mean, list_sum(list_transform(g, lambda x: x * x)) / 64.0 - power(list_sum(g) / 64.0, 2) AS var FROM v_geno),
    x AS (SELECT CHR, SNP, BP, pos, least(mean / 2, 1 - mean / 2) AS maf, CASE WHEN var > 1e-12 THEN list_transform(g, lambda y: (y - mean) / sqrt(var)) ELSE list_transform(g, lambda y: 0.0) END AS x FROM st)"""


@query(f"{_STD} SELECT CHR, pos, round(maf, 6) AS maf FROM x", "v_geno")
def maf_stats(v: Views) -> DataFrame:
    return ldscore.snp_stats(v.geno).select("CHR", "pos", r("maf").alias("maf"))


@query(
    f"{_STD} SELECT CHR, pos, round(list_sum(x), 6) + 0.0 AS total, round(list_sum(list_transform(x, lambda y: y * y)), 6) AS "
    f"norm, round(x[1], 6) AS first FROM x",
    "v_geno",
)
def genotype_standardize(v: Views) -> DataFrame:
    df = ldscore.standardised(v.geno)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y)
    return df.select(
        "CHR", "pos", (r(total("x")) + 0.0).alias("total"), r(total(F.transform("x", lambda y: y * y))).alias("norm"),
        r(F.col("x")[0]).alias("first")
    )


@query(
    f"{_STD} SELECT CHR, pos, round(CASE WHEN list_sum(list_transform(x, lambda y: y * y)) > 0 THEN list_sum(list_transform(x, "
    f"lambda y: power(y, 4))) / power(list_sum(list_transform(x, lambda y: y * y)), 2) ELSE 0 END, 6) AS kappa FROM x",
    "v_geno",
)
def genotype_kurtosis(v: Views) -> DataFrame:
    return ldscore.standardised(v.geno).select("CHR", "pos", r(ldscore.kurtosis(F.col("x"))).alias("kappa"))


@query(
    "SELECT CHR, pos, min(pos) OVER (PARTITION BY CHR ORDER BY BP RANGE BETWEEN 500000 PRECEDING AND CURRENT ROW) AS block_left "
    "FROM v_bim",
    "v_bim",
)
def block_left_kb(v: Views) -> DataFrame:
    return windows.block_left_kb(v.bim, 500).select("CHR", "pos", "block_left")


@query("SELECT CHR, pos, min(pos) OVER (PARTITION BY CHR ORDER BY CM RANGE BETWEEN 0.25 PRECEDING AND CURRENT ROW) AS block_left FROM v_bim", "v_bim")
def block_left_cm(v: Views) -> DataFrame:
    return windows.block_left_cm(v.bim, 0.25).select("CHR", "pos", "block_left")


@query("SELECT CHR, pos, greatest(pos - 10, 0) AS block_left FROM v_bim", "v_bim")
def block_left_snps(v: Views) -> DataFrame:
    return windows.block_left_snps(v.bim, 10).select("CHR", "pos", "block_left")


_LEFT = f"{_STD}, w AS (SELECT *, min(pos) OVER (PARTITION BY CHR ORDER BY BP RANGE BETWEEN 200000 PRECEDING AND CURRENT ROW) AS block_left FROM x)"
_CHUNKED = ", c AS (SELECT *, first_value(block_left) OVER (PARTITION BY CHR, pos // 20 ORDER BY pos) // 20 * 20 AS lft FROM w)"
_EXACT = ", c AS (SELECT *, block_left AS lft FROM w)"
_PAIR = ", p AS (SELECT a.CHR, a.pos AS i, b.pos AS j, list_inner_product(a.x, b.x) / 64 AS r FROM c a JOIN c b ON a.CHR = b.CHR AND a.pos < b.pos AND a.pos >= b.lft), q AS (SELECT CHR, i, j, r * r - (1 - r * r) / 62 AS r2 FROM p)"


def _score_sql(head: str, weights: dict[str, str]) -> str:
    both = ", u AS (SELECT CHR, i AS pos, j AS other, r2 FROM q UNION ALL SELECT CHR, j, i, r2 FROM q)"
    sums = ", ".join(
        f"round(any_value({w.replace('@', 'm')}) + coalesce(sum(r2 * {w.replace('@', 'o')}), 0), 5) AS {name}" for name,
        w in weights.items()
    )
    return f"{_LEFT}{head}{_PAIR}{both} SELECT m.CHR, m.pos, {sums} FROM c m LEFT JOIN u ON u.CHR = m.CHR AND u.pos = m.pos LEFT JOIN c o ON o.CHR = m.CHR AND o.pos = u.other GROUP BY m.CHR, m.pos"


def _scored(v: Views, weights: dict[str, Column], chunk: int | None, kb: float = 200, prepare=lambda df: df) -> DataFrame:
    left = windows.effective_left(windows.block_left_kb(prepare(ldscore.standardised(v.geno)), kb), chunk)
    got = ldscore.scores(left.withColumn("a", F.array(*[w.cast("double") for w in weights.values()])), 64)
    return got.select("CHR", "pos", *[r(F.col("l2")[i], 5).alias(name) for i, name in enumerate(weights)])


@query(_score_sql(_EXACT, {"L2": "CASE WHEN @.pos >= 0 THEN 1 END"}), "v_geno")
def ld_score_exact(v: Views) -> DataFrame:
    return _scored(v, {"L2": F.lit(1.0)}, None)


@query(_score_sql(_CHUNKED, {"L2": "CASE WHEN @.pos >= 0 THEN 1 END"}), "v_geno")
def ld_score_chunked(v: Views) -> DataFrame:
    return _scored(v, {"L2": F.lit(1.0)}, 20)


@query(_score_sql(_CHUNKED, {"baseL2": "CASE WHEN @.pos >= 0 THEN 1 END", "oddL2": "(@.pos % 2)"}), "v_geno")
def ld_score_annot(v: Views) -> DataFrame:
    return _scored(v, {"baseL2": F.lit(1.0), "oddL2": F.pmod("pos", F.lit(2))}, 20)


@query(_score_sql(_CHUNKED, {"L2": "(@.maf * (1 - @.maf))"}), "v_geno")
def ld_score_per_allele(v: Views) -> DataFrame:
    return _scored(v, {"L2": ldscore.allele_weight(F.col("maf"), 1)}, 20)


@query(f"{_LEFT}{_EXACT}{_PAIR} SELECT CHR, i, j, round(r2, 6) + 0.0 AS r2 FROM q", "v_geno")
def ld_pairs(v: Views) -> DataFrame:
    left = windows.effective_left(windows.block_left_kb(ldscore.standardised(v.geno), 200), None)
    return ldscore.pairs(left, 64).select("CHR", "i", "j", (r("r2") + 0.0).alias("r2"))


_GLOBAL = f"""{_LEFT}, g AS (SELECT (CHR - 1) * 125 + pos AS place, (CHR - 1) * 125 + block_left AS first, x FROM w),
    c AS (SELECT *, first_value(first) OVER (PARTITION BY place // 50 ORDER BY place) // 50 * 50 AS lft FROM g),
    q AS (SELECT a.place AS i, b.place AS j, power(list_inner_product(a.x, b.x) / 64, 2) - (1 - power(list_inner_product(a.x, b.x) / 64, 2)) / 62 AS r2 FROM c a JOIN c b ON a.place < b.place AND a.place >= b.lft),
    u AS (SELECT i AS place, r2 FROM q UNION ALL SELECT j, r2 FROM q)
    SELECT c.place AS pos, round(1 + coalesce(sum(r2), 0), 5) AS L2 FROM c LEFT JOIN u ON u.place = c.place GROUP BY c.place"""


@query(_GLOBAL, "v_geno")
def ld_score_global_pass(v: Views) -> DataFrame:
    """Positions run over the whole table, so pairs of a chunk may cross chromosomes."""
    df = windows.block_left_kb(ldscore.standardised(v.geno), 200)
    df = df.withColumns(
        {"pos": (F.col("CHR") - 1) * 125 + F.col("pos"), "block_left": (F.col("CHR") - 1) * 125 + F.col("block_left"), "all": F.lit(0)}
    )
    got = ldscore.scores(windows.effective_left(df, 50, "all").withColumn("a", F.array(F.lit(1.0))), 64, "all")
    return got.select("pos", r(F.col("l2")[0], 5).alias("L2"))


@query()
def ld_score_sketch(v: Views) -> DataFrame:
    """LD scores out of 32 sketch dimensions for 64 individuals, squared correlations corrected for the sketch."""
    left = windows.effective_left(windows.block_left_kb(sketch.project(ldscore.standardised(v.geno), 64, 32), 200), None)
    got = ldscore.scores(left.withColumn("a", F.array(F.lit(1.0))), 64, sketch=32)
    return got.select("CHR", "pos", r(F.col("l2")[0], 5).alias("L2"))


_DISC = "((29.0 - n % 3) * (29.0 - n % 3) + 8 * ((32.0 - n % 3) * t - 1))"


@query(
    f"WITH t AS (SELECT num AS n, maf AS t FROM v_ld) SELECT n, round(CASE WHEN {_DISC} < 0 THEN 0 ELSE (-(29.0 - n % 3) + "
    f"sqrt({_DISC})) / 4 END, 6) + 0.0 AS r2 FROM t",
    "v_ld",
)
def sketch_correction(v: Views) -> DataFrame:
    d = 32 - F.pmod("num", F.lit(3))
    return v.ld.select(F.col("num").alias("n"), (r(C.sketch_r2(F.col("maf"), d.cast("double"))) + 0.0).alias("r2"))


@query(
    "SELECT CHR, CAST(count(*) AS DOUBLE) AS M, CAST(coalesce(sum(CASE WHEN maf > 0.05 THEN 1 END), 0) AS DOUBLE) AS M_5_50 FROM "
    "v_ld GROUP BY CHR",
    "v_ld",
)
def m_5_50(v: Views) -> DataFrame:
    return ldscore.counts(v.ld.withColumn("one", F.lit(1.0)), ["one"], ["CHR"]).select(
        "CHR", F.col("one_M").alias("M"), F.col("one_M_5_50").alias("M_5_50")
    )


_DESC = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM v_ld"


@query(" UNION ALL ".join(_DESC.replace("{c}", c) for c in ("maf", "L2")), "v_ld")
def ld_summary(v: Views) -> DataFrame:
    got = frames.describe(v.ld, ["maf", "L2"])
    return got.select("column", "n", *[r(c).alias(c) for c in ("mean", "sd")], "min", *[r(c).alias(c) for c in ("q25", "median", "q75")], "max")


@query(
    "SELECT 'maf' AS a, 'maf' AS b, round(corr(maf, maf), 6) AS r FROM v_ld UNION ALL SELECT 'maf', 'L2', round(corr(maf, L2), 6) "
    "FROM v_ld UNION ALL SELECT 'L2', 'L2', round(corr(L2, L2), 6) FROM v_ld",
    "v_ld",
)
def maf_ld_corr(v: Views) -> DataFrame:
    return frames.correlations(v.ld, ["maf", "L2"]).select("a", "b", r("r").alias("r"))


@query("SELECT SNP, CHR, L2 FROM v_ld", "v_ld")
def concat_chr(v: Views) -> DataFrame:
    ld = v.ld.select("SNP", "CHR", "L2")
    return frames.stacked([ld.where(F.col("CHR") <= 11), ld.where(F.col("CHR") > 11)]).drop("_part")


@query("SELECT CHR, SNP, array_to_string(g, '') AS g FROM v_geno", "v_geno")
def bed_decode(v: Views) -> DataFrame:
    """Genotypes packed to two bits and decoded again."""
    packed = v.geno.select("CHR", "SNP", plink.pack(F.col("g")).alias("bytes"))
    return packed.select("CHR", "SNP", F.array_join(plink.decode(F.col("bytes"), 64).cast("array<string>"), "").alias("g"))


# --- annotations -------------------------------------------------------------------------------------------------

_MERGED = """WITH a AS (SELECT CHR, greatest(s - 100, 0) AS s, e + 100 AS e FROM v_intervals),
    b AS (SELECT *, max(e) OVER (PARTITION BY CHR ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a),
    c AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY CHR ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b),
    m AS (SELECT CHR, min(s) AS s, max(e) AS e FROM c GROUP BY CHR, g)"""


@query(f"{_MERGED} SELECT * FROM m", "v_intervals")
def interval_merge(v: Views) -> DataFrame:
    return annotations.merged(v.intervals, 100)


@query(
    f"{_MERGED} SELECT b.CHR, b.BP, b.SNP, CAST(EXISTS (SELECT 1 FROM m WHERE m.CHR = b.CHR AND m.s < b.BP AND b.BP <= m.e) AS "
    f"INTEGER) AS ANNOT FROM v_bim b",
    "v_intervals", "v_bim",
)
def interval_annotate(v: Views) -> DataFrame:
    return annotations.in_intervals(v.bim.select("CHR", "BP", "SNP"), annotations.merged(v.intervals, 100))


@query(
    "SELECT b.CHR, b.BP, b.SNP, coalesce((SELECT max_by(CAST(b.BP <= i.e AS INTEGER), (i.s, i.e)) FROM v_intervals i WHERE i.CHR "
    "= b.CHR AND i.s < b.BP), 0) AS ANNOT FROM v_bim b",
    "v_intervals", "v_bim",
)
def interval_annotate_unmerged(v: Views) -> DataFrame:
    """Without merging only the last interval that starts before the SNP counts."""
    return annotations.in_intervals(v.bim.select("CHR", "BP", "SNP"), v.intervals)


@query(
    'WITH g AS (SELECT CHR, greatest("START" - 5000, 0) AS s, "END" + 5000 AS e FROM v_genes WHERE s_acctbal > 0) SELECT b.CHR, '
    'b.BP, b.SNP, CAST(EXISTS (SELECT 1 FROM g WHERE g.CHR = b.CHR AND g.s < b.BP AND b.BP <= g.e) AS INTEGER) AS GENESET FROM '
    'v_bim b',
    "v_genes", "v_bim",
)
def gene_set_annotate(v: Views) -> DataFrame:
    genes = v.genes
    spans = annotations.merged(annotations.gene_intervals(genes.where("s_acctbal > 0"), genes.select("GENE", "CHR", "START", "END")), 5000)
    return annotations.in_intervals(v.bim.select("CHR", "BP", "SNP"), spans, "GENESET")


_BIN = "CASE WHEN maf <= 0.1 THEN 0 WHEN maf <= 0.25 THEN 1 ELSE 2 END"


@query(f"SELECT SNP, {_BIN} AS bin FROM v_ld", "v_ld")
def cts_bins(v: Views) -> DataFrame:
    low, high = v.ld.agg(F.min("maf"), F.max("maf")).first()
    return v.ld.select("SNP", annotations.bin_of(F.col("maf"), annotations.edges([0.1, 0.25], low, high)[0]).alias("bin"))


_HOT = {
    f"maf_{a}_L2_{b}": f"{x} AND {y}" for a,
    x in (("min_0.1", "maf <= 0.1"), ("0.1_0.25", "maf > 0.1 AND maf <= 0.25"), ("0.25_max", "maf > 0.25")) for b,
    y in (("min_10", "L2 <= 10"), ("10_max", "L2 > 10"))
}


@query("SELECT SNP, " + ", ".join(f'CAST({c} AS INTEGER) AS "{n}"' for n, c in _HOT.items()) + " FROM v_ld", "v_ld")
def cts_onehot(v: Views) -> DataFrame:
    df, names = annotations.one_hot(v.ld, ["maf", "L2"], [[0.1, 0.25], [10.0]])
    return df.select("SNP", *[F.col(f"`{n}`") for n in names])


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CAST(coalesce(sum({a} * {b}), 0) AS DOUBLE) AS value FROM v_annot WHERE FRQ > 0.05 AND FRQ < 0.95" for a in ("base", "coding", "enh") for b in ("base", "coding", "enh")
    ),
    "v_annot"
)
def annot_overlap(v: Views) -> DataFrame:
    return annotations.overlap(v.annot, ["base", "coding", "enh"])
