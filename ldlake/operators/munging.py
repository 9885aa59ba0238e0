"""Cleaning and harmonising association summary statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric, same_or_flipped, valid_alleles, with_probit
from .frames import first_of, join_first, rename, select

#: Accepted header names for each canonical column.
SYNONYMS = {
    "SNP": ("SNP", "MARKERNAME", "SNPID", "RS", "RSID", "RS_NUMBER", "RS_NUMBERS"),
    "P": ("P", "PVALUE", "P_VALUE", "PVAL", "P_VAL", "GC_PVALUE"),
    "A1": ("A1", "ALLELE1", "ALLELE_1", "EFFECT_ALLELE", "REFERENCE_ALLELE", "INC_ALLELE", "EA"),
    "A2": ("A2", "ALLELE2", "ALLELE_2", "OTHER_ALLELE", "NON_EFFECT_ALLELE", "DEC_ALLELE", "NEA"),
    "N": ("N", "WEIGHT"),
    "Z": ("Z", "ZSCORE", "Z-SCORE", "GC_ZSCORE"),
    "BETA": ("BETA", "B", "EFFECT", "EFFECTS"),
    "OR": ("OR",),
    "LOG_ODDS": ("LOG_ODDS",),
    "SIGNED_SUMSTAT": ("SIGNED_SUMSTAT",),
    "SE": ("SE", "STDERR", "STDERROR", "SE_BETA"),
    "FRQ": ("FRQ", "MAF", "EAF", "FRQ_U", "F_U"),
    "INFO": ("INFO", "IMPINFO"),
}
CANONICAL = {name: to for to, names in SYNONYMS.items() for name in names}
NUMERIC = ("P", "N", "Z", "BETA", "OR", "LOG_ODDS", "SIGNED_SUMSTAT", "SE", "FRQ", "INFO", "N_CAS", "N_CON", "NSTUDY")
#: Columns that tell the sign, and the value that stands for no effect.
SIGNED = (("BETA", 0.0), ("LOG_ODDS", 0.0), ("OR", 1.0))


@dataclass(frozen=True)
class MungeOptions:
    daner: bool = False
    daner_n: bool = False
    n_min: float = 0.0
    maf_min: float = 0.01
    info_min: float = 0.9
    n: float | None = None
    n_cas: float | None = None
    n_con: float | None = None
    columns: dict[str, str] = field(default_factory=dict)  # canonical -> name in the file
    signed_sumstats: str | None = None  # NAME,null value
    ignore: tuple[str, ...] = ()
    keep_maf: bool = False
    a1_inc: bool = False
    no_alleles: bool = False
    info_list: tuple[str, ...] = ()
    nstudy: str | None = None
    nstudy_min: float | None = None

    def __post_init__(self):
        if self.daner and self.daner_n:
            raise ValueError("daner and daner-n are not compatible")


def without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Drop columns by name, whatever their case."""
    wanted = {x.upper() for x in names}
    return df.drop(*[c for c in df.columns if c.upper() in wanted])


def daner_columns(df: DataFrame, opts: MungeOptions) -> tuple[DataFrame, float | None, float | None]:
    """daner files: frequency of controls as FRQ; counts from header suffixes or from Nca and Nco."""
    if not (opts.daner or opts.daner_n):
        return df, opts.n_cas, opts.n_con
    controls = [c for c in df.columns if c.upper().startswith("FRQ_U_")]
    if not controls:
        raise ValueError("daner: no column FRQ_U_...")
    df = df.drop(*[c for c in df.columns if CANONICAL.get(c.upper()) == "FRQ"])
    n_cas, n_con = opts.n_cas, opts.n_con
    if opts.daner:
        cases = [c for c in df.columns if c.upper().startswith("FRQ_A_")]
        if not cases:
            raise ValueError("daner: no column FRQ_A_...")
        n_cas, n_con = (float(re.sub(r"^FRQ_[AU]_", "", c, flags=re.I)) for c in (cases[0], controls[0]))
    else:
        names = {c.upper(): c for c in df.columns}
        if "NCA" not in names or "NCO" not in names:
            raise ValueError("daner-n: no columns Nca and Nco")
        df = rename(df, {names["NCA"]: "N_CAS", names["NCO"]: "N_CON"})
    return rename(df, {controls[0]: "FRQ"}), n_cas, n_con


def canonical_columns(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Named columns first, then synonyms; two columns for one canonical name are an error."""
    given = {v.upper(): k for k, v in overrides.items()}
    df = rename(df, {c: given[c.upper()] for c in df.columns if c.upper() in given})
    taken = set(overrides)
    return rename(df, {c: CANONICAL[c.upper()] for c in df.columns if c.upper() in CANONICAL and c not in taken})


def info_mean(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """INFO as the mean of the listed columns; one missing makes it missing."""
    if not names:
        return df
    have = {c.upper(): c for c in df.columns}
    parts = [numeric(df, have[x.upper()]) for x in names]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("INFO", total / len(parts))


def sample_size(df: DataFrame, n: float | None, n_cas: float | None, n_con: float | None) -> DataFrame:
    """N given, or cases + controls given, or from N_CAS and N_CON: N_CAS over the case share at the largest total."""
    if n is not None:
        return df.withColumn("N", F.lit(float(n)))
    if n_cas is not None and n_con is not None:
        return df.withColumn("N", F.lit(float(n_cas + n_con)))
    if "N_CAS" not in df.columns or "N_CON" not in df.columns:
        return df
    both = F.col("N_CAS") + F.col("N_CON")
    top = df.agg(F.max(both).alias("top"))
    share = df.join(F.broadcast(top)).agg(
        F.coalesce(F.avg(F.when(both == F.col("top"), F.col("N_CAS") / both)), F.lit(1.0)).alias("share")
    )  # both sides of one row
    return df.join(F.broadcast(share)).withColumn("N", F.col("N_CAS") / F.col("share")).drop("share", "N_CAS", "N_CON")


def p_in_range(df: DataFrame) -> DataFrame:
    return df.where("P > 0 AND P <= 1") if "P" in df.columns else df


def _effect(df: DataFrame, signed: str | None) -> Column | None:
    """The signed column that tells the direction of Z, less the value of no effect."""
    have, choice = df.columns, None
    if signed:
        name, _, null = signed.partition(",")
        found = [c for c in have if c.upper() == name.strip().upper() or c == CANONICAL.get(name.strip().upper())]
        choice = (found[0], float(null)) if found else None
    choice = choice or next(((c, x) for c, x in SIGNED if c in have), None)
    return numeric(df, choice[0]) - choice[1] if choice else None


def has_z(df: DataFrame, signed: str | None = None, a1_inc: bool = False) -> Column:
    """Whether ``derive_z`` gives a Z, without computing it: filters on Z itself would repeat its formula."""
    have = df.columns
    if "P" in have:
        effect = _effect(df, signed)
        if a1_inc or effect is not None:
            known = F.col("P").isNotNull() & ~F.isnan("P")
            return known if a1_inc else known & F.coalesce(effect != 0, F.lit(False))
    if "Z" in have:
        return F.col("Z").isNotNull()
    return F.col("BETA").isNotNull() & F.coalesce(F.col("SE") != 0, F.lit(False))


def derive_z(df: DataFrame, signed: str | None = None, a1_inc: bool = False) -> DataFrame:
    """Z from P and a signed column, else as it is, else from BETA and SE. A value of no effect gives a missing Z."""
    have = df.columns
    if "P" in have and a1_inc:
        return with_probit(df, "P", "Z")
    if "P" in have and (effect := _effect(df, signed)) is not None:
        size = with_probit(df, "P", "_size")
        return size.withColumn("Z", F.when(effect > 0, F.col("_size")).when(effect < 0, -F.col("_size"))).drop("_size")
    if "Z" in have:
        return df
    if "BETA" in have and "SE" in have:
        return df.withColumn("Z", F.col("BETA") / F.when(F.col("SE") != 0, F.col("SE")))
    raise ValueError("no way to Z: P with a signed column, Z, or BETA and SE are needed")


def n_at_least(df: DataFrame, n_min: float) -> DataFrame:
    """N >= n_min; 0 stands for the 90th percentile over 1.5. One-row side, so a broadcast of one row."""
    if "N" not in df.columns:
        return df
    if n_min > 0:
        return df.where(F.col("N") >= n_min)
    least = df.agg((F.percentile("N", 0.9) / 1.5).alias("_least"))
    return df.join(F.broadcast(least)).where("_least IS NULL OR _least <= 0 OR N >= _least").drop("_least")


def frequency_above(df: DataFrame, maf: float) -> DataFrame:
    return df.where((F.col("FRQ") >= 0) & (F.col("FRQ") <= 1) & (F.least("FRQ", 1 - F.col("FRQ")) > maf)) if "FRQ" in df.columns else df


def info_at_least(df: DataFrame, info: float) -> DataFrame:
    return df.where(F.col("INFO") >= info) if "INFO" in df.columns else df


def alleles_valid(df: DataFrame) -> DataFrame:
    return df.withColumns({"A1": F.upper("A1"), "A2": F.upper("A2")}).where(valid_alleles(F.col("A1"), F.col("A2")))


def studies_at_least(df: DataFrame, name: str | None, least: float | None) -> DataFrame:
    found = [c for c in df.columns if name and c.upper() == name.upper()]
    return df.where(numeric(df, found[0]) >= least) if found and least is not None else df


def merge_alleles(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Keep SNPs of the reference (SNP, A1, A2) whose alleles are the same, on either strand and in either order."""
    order = F.col("_row") if "_row" in reference.columns else F.struct("A1", "A2")
    ref = reference.select("SNP", F.upper("A1").alias("_b1"), F.upper("A2").alias("_b2"), order.alias("_at"))
    met = join_first(df, ref, "SNP", [F.col("_at")]).drop("_at")
    return met.where(same_or_flipped(F.col("A1"), F.col("A2"), F.col("_b1"), F.col("_b2")).isNotNull()).drop("_b1", "_b2")


def drop_missing(df: DataFrame, but: tuple[str, ...] = ("INFO", "_row")) -> DataFrame:
    """Without rows that lack a value in any column but INFO, columns without use for the result too."""
    keep = F.lit(True)
    for name, kind in df.dtypes:
        if name in but:
            continue
        c = F.col(f"`{name}`")
        keep &= c.isNotNull() & (F.trim(c) != "" if kind == "string" else ~F.isnan(c) if kind in ("double", "float") else F.lit(True))
    return df.where(keep)


def typed_once(df: DataFrame) -> DataFrame:
    """Canonical columns as numbers and trimmed text, each cell parsed once.

    Filters that follow would be pushed below this projection and parse the cells again in each test. A projection
    with a number that isn't deterministic stays where it is, and so do they.
    """
    numbers = {c: numeric(df, c) for c in df.columns if c in NUMERIC}
    texts = {c: F.trim(F.col(c).cast("string")) for c in df.columns if c == "SNP"} | {
        c: F.upper(F.trim(F.col(c).cast("string"))) for c in df.columns if c in ("A1", "A2")
    }
    return df.withColumns(numbers | texts | {"_once": F.monotonically_increasing_id()}).where("_once >= 0").drop("_once")


def stages(raw: DataFrame, opts: MungeOptions = MungeOptions(), reference: DataFrame | None = None):
    """Yield (name, table) after each stage that can lose rows, in their fixed order; the last has the result's columns and _row.

    The order is visible in results: the percentile behind the default n_min is taken after the P
    filter and before all others. Z comes last, as no other stage reads it and rows without one are known before.
    """
    if opts.no_alleles and reference is not None:
        raise ValueError("no-alleles and merge-alleles are not compatible")
    df = without(raw, opts.ignore)
    df, n_cas, n_con = daner_columns(df, opts)
    df = canonical_columns(df, opts.columns)
    df = info_mean(typed_once(df), opts.info_list)
    yield "read", df
    df = p_in_range(sample_size(df, opts.n, n_cas, n_con))
    yield "P out of range", df
    derive_z(df, opts.signed_sumstats, opts.a1_inc)  # says what is missing, if there is no way
    for name, step in (
        ("N", lambda d: n_at_least(d, opts.n_min)), ("FRQ", lambda d: frequency_above(d, opts.maf_min)),
        ("INFO", lambda d: info_at_least(d, opts.info_min))
    ):
        df = step(df)
        yield name, df
    if not opts.no_alleles:
        df = alleles_valid(df)
        yield "alleles", df
    df = studies_at_least(df, opts.nstudy, opts.nstudy_min)
    yield "studies", df
    if reference is not None:
        df = merge_alleles(df, reference)
        yield "merge-alleles", df
    replaced = ("Z",) if "P" in df.columns else ()  # what P and the sign stand for
    df = drop_missing(df.where(has_z(df, opts.signed_sumstats, opts.a1_inc)), ("INFO", "_row", *replaced))
    out = ["SNP", *([] if opts.no_alleles else ["A1", "A2"]), "Z", "N", *(["FRQ"] if opts.keep_maf else []), "_row"]
    select(derive_z(df, opts.signed_sumstats, opts.a1_inc), out)  # a missing column is told before anything runs
    told = (opts.signed_sumstats or "").partition(",")[0].strip().upper()
    sources = [c for c in df.columns if c in ("P", "Z", "BETA", "SE", "OR", "LOG_ODDS", "SIGNED_SUMSTAT") or c.upper() == told]
    df = df.select(*dict.fromkeys([*(c for c in out if c != "Z"), *sources]))
    yield "missing values", df
    # Z is made of what a row has, so only rows that stay need one
    yield "duplicates", derive_z(first_of(df, ["SNP"], [F.col("_row")]), opts.signed_sumstats, opts.a1_inc).select(*out)


def munge(raw: DataFrame, opts: MungeOptions = MungeOptions(), reference: DataFrame | None = None) -> DataFrame:
    """SNP[, A1, A2], Z, N[, FRQ] in one lazy plan; ``_row`` tells the order for which the first of a SNP stays."""
    for _, df in stages(raw, opts, reference):
        pass
    return df


def removed(raw: DataFrame, opts: MungeOptions = MungeOptions(), reference: DataFrame | None = None) -> list[tuple[str, int]]:
    """(stage, rows it removed), in order; the first counts what was read. A count for each stage."""
    sizes = [(name, df.count()) for name, df in stages(raw, opts, reference)]
    return [sizes[0], *[(name, before - n) for (_, before), (name, n) in zip(sizes, sizes[1:])]]
