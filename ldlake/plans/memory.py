"""The library over inputs that are in memory: small files whose bytes the caller holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number
from ..operators import frames, ldscore, windows
from ..sources import plink, readers
from ..sources.shared import cut
from ..stats import regression

LEAST_ROWS = 200


def bim_table(spark: SparkSession, text: str) -> DataFrame:
    """CHR, SNP, CM, BP, bed_idx of a BIM's text."""
    def whole(x: str, kind=int):
        try:
            return kind(x)
        except ValueError:
            return kind(0)

    rows = [line.split("\t") for line in text.splitlines() if line.strip()]
    return spark.createDataFrame(
        [(whole(c[0]), c[1], whole(c[2], float), whole(c[3]), i) for i, c in enumerate(rows)],
        "CHR int, SNP string, CM double, BP long, bed_idx long"
    )


def chromosome_counts(bim: DataFrame) -> DataFrame:
    return bim.groupBy("CHR").agg(F.count("*").alias("n"))


def balanced(counts: dict[int, int], workers: int) -> list[list[int]]:
    """Chromosomes for each worker: the largest first, to the one that has least so far."""
    load, out = [0] * workers, [[] for _ in range(workers)]
    for c, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        k = min(range(workers), key=lambda i: (load[i], i))
        load[k] += n
        out[k].append(c)
    return out


def l2_from_bytes(
    spark: SparkSession, bed: bytes, bim: str, people: int, kb: float | None = None, cm: float | None = None, snps: int | None = None,
    chunk: int | None = 200, chromosomes: list[int] | None = None, progress: Callable[[int, int], None] | None = None
) -> DataFrame:
    """CHR, SNP, BP, bed_idx, maf, L2; of some chromosomes, if they are given.

    With ``progress`` chromosomes are computed one after the other, and it is told how many of how many SNPs are done.
    """
    table = bim_table(spark, bim)
    if progress:
        sizes = {r["CHR"]: r["n"] for r in chromosome_counts(table).collect() if not chromosomes or r["CHR"] in chromosomes}
        out, done = None, 0
        for c, n in sorted(sizes.items()):
            part = cut(l2_from_bytes(spark, bed, bim, people, kb, cm, snps, chunk, [c]))
            out, done = part if out is None else out.unionByName(part), done + n
            progress(done, sum(sizes.values()))
        return out
    geno = plink.from_bytes(spark, bed, people, table.count())
    if chromosomes:
        table = table.where(F.col("CHR").isin(*chromosomes))
    df = windows.positions(ldscore.standardised(table.join(geno, "bed_idx")), [F.col("bed_idx")])
    placed = windows.effective_left(windows.window(df, cm, kb, snps), chunk).withColumn("a", F.array(F.lit(1.0)))
    return placed.join(ldscore.scores(placed, people), ["CHR", "pos"]).select("CHR", "SNP", "BP", "bed_idx", "maf", F.col("l2")[0].alias("L2"))


def h2_from_bytes(spark: SparkSession, sumstats: bytes, scores: DataFrame, blocks: int = 200, step: float | None = 30.0) -> regression.Heritability:
    """Heritability with the LD scores as weights too; M counts SNPs with maf >= 0.05; the last of a SNP's scores counts."""
    stats = readers.decode_table(spark, sumstats).select(
        "SNP", number(F.col("Z")).alias("Z"), number(F.col("N")).alias("N"), "_row"
    ).where("Z is not null and N > 0")
    last = frames.first_of(scores, ["SNP"], [-F.col("bed_idx")]).select("SNP", "L2", F.col("L2").alias("w_l2"))
    df = frames.numbered(stats.join(last, "SNP").withColumn("chi2", F.col("Z") * F.col("Z")), [F.col("_row")], "_i").persist()
    try:
        n = df.count()
        if n < LEAST_ROWS:
            raise ValueError(f"{n} SNPs are left, {LEAST_ROWS} are needed")
        m = scores.where("maf >= 0.05").count()
        return regression.heritability(df, ["L2"], [float(m)], min(max(blocks, 2), n // 2), step)
    finally:
        df.unpersist()
