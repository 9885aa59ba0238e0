"""LD-score regression: aggregations in Spark, p x p algebra on the driver.

A regression table has one row for each SNP: ``_i`` (0-based position in file order), ``chi2`` or ``Z1`` and
``Z2``, sample sizes, LD score columns and ``w_l2``. Each pass is one aggregation of sums of products.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import covariance_weight, regression_weight
from ..operators.frames import numbered
from .distributions import chi2_1_sf, normal_sf, student_t_sf
from .jackknife import Jackknife, from_block_sums, ratio, two_step

MEDIAN_CHI2 = 0.4549  # as a fixed value: median of chi-square with one degree of freedom


def block_of(i: Column, n: int | Column, blocks: int) -> Column:
    """Contiguous blocks that begin at floor(k n / blocks)."""
    n = n if isinstance(n, Column) else F.lit(n)
    top = (i + 1) * F.lit(blocks) - 1
    return ((top - F.pmod(top, n)) / n).cast("long")  # whole division


def block_sums(df: DataFrame, xs: list[Column], y: Column, w: Column, block: Column) -> DataFrame:
    """(block, n, xx_ij for i <= j, xy_i): weighted sums of products, map-side combined."""
    p = len(xs)
    rows = df.select(block.alias("block"), w.alias("w"), y.alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col("w") * F.col(f"x{i}") * F.col("y")).alias(f"xy_{i}") for i in range(p)]
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.min("w").alias("least"), *sums)


def gram(df: DataFrame, xs: list[Column], y: Column, w: Column, block: Column | None = None, blocks: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums by block as arrays, 0 for a block without rows; a weight that isn't positive is an error."""
    p = len(xs)
    rows = block_sums(df, xs, y, w, F.lit(0) if block is None else block).orderBy("block").collect()
    if any(r["least"] is None or not r["least"] > 0 for r in rows):
        raise ValueError("weights must be positive")
    xx, xy = np.zeros((blocks, p, p)), np.zeros((blocks, p))
    for r in rows:
        b = r["block"]
        for i in range(p):
            xy[b, i] = r[f"xy_{i}"]
            for j in range(i, p):
                xx[b, i, j] = xx[b, j, i] = r[f"xx_{i}_{j}"]
    return xx, xy


def reweighted(
    df: DataFrame, xs: list[Column], y: Column, w: Column, update: Callable[[np.ndarray], Column], block: Column, blocks: int
) -> Jackknife:
    """Two rounds of new weights from the estimate, then the jackknife."""
    for _ in range(2):
        xx, xy = gram(df, xs, y, w)
        w = update(np.linalg.solve(xx[0], xy[0]))
    return from_block_sums(*gram(df, xs, y, w, block, blocks))


def moved_blocks(df: DataFrame, mask: Column, n1: int, blocks: int) -> Column:
    """Blocks of all rows whose borders are those of the kept rows' blocks, by position."""
    borders = sorted({(k * n1) // blocks for k in range(1, blocks)})
    kept = numbered(df.where(mask).select("_i"), [F.col("_i")], "_k")
    at = {r["_k"]: r["_i"] for r in kept.where(F.col("_k").isin(borders)).collect()}  # a row for each block
    places = [at[(k * n1) // blocks] for k in range(1, blocks)]
    if not places:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: p <= F.col("_i")))


@dataclass(frozen=True)
class Heritability:
    h2: float
    se: float
    intercept: float
    intercept_se: float
    mean_chi2: float
    lambda_gc: float
    ratio: float
    ratio_se: float
    delete: np.ndarray
    jackknife: Jackknife


def _totals(jk: Jackknife, m: list[float], n_mean: float) -> tuple[float, float, np.ndarray]:
    k, mv = len(m), np.array(m)
    cov = jk.cov[:k, :k] / n_mean**2
    return float(mv @ jk.est[:k] / n_mean), math.sqrt(max(float(mv @ cov @ mv), 0.0)), jk.delete[:, :k] @ mv / n_mean


def heritability(
    df: DataFrame, ld: list[str], m: list[float], blocks: int = 200, step: float | None = None, intercept: float | None = None,
    chi2: str = "chi2", n: str = "N", w: str = "w_l2"
) -> Heritability:
    """Total heritability with one or several LD columns (free or fixed intercept, one or two steps)."""
    if step is not None and (intercept is not None or len(ld) > 1):
        raise ValueError("two steps need a free intercept and one LD score column")
    y, nn, wl = F.col(chi2), F.col(n), F.col(w)
    total = sum((F.col(c) for c in ld[1:]), F.col(ld[0]))
    m_total = float(sum(m))
    first = df.agg(
        F.count("*").alias("n"), F.avg(n).alias("n_mean"), F.avg(chi2).alias("y_mean"), F.avg(total * nn).alias("xn"),
        F.median(chi2).alias("median"), *([F.count_if(y < step).alias("n1")] if step is not None else [])
    ).first()
    n_all, n_mean = first["n"], first["n_mean"]
    blocks = min(n_all, blocks)
    start = 1.0 if intercept is None else intercept
    w0 = regression_weight(total, wl, nn, m_total, m_total * (first["y_mean"] - start) / first["xn"], start)
    xs = [nn * F.col(c) / n_mean for c in ld]
    k = len(ld)
    if step is not None:
        small, block = df.where(y < step), moved_blocks(df, y < step, first["n1"], blocks)
        one = reweighted(
            small, [*xs, F.lit(1.0)], y, w0, lambda c: regression_weight(xs[0], wl, nn, m_total, m_total * c[0] / n_mean, c[1]), block,
            blocks
        )
        int1 = float(one.est[1])
        two = reweighted(df, xs, y - int1, w0, lambda c: regression_weight(total, wl, nn, m_total, m_total * c[0] / n_mean, int1), block, blocks)
        c = df.agg((F.sum(w0 * xs[0]) / F.sum(w0 * xs[0] * xs[0])).alias("c")).first()["c"]
        jk = two_step(one, two, c)
    else:
        free = intercept is None
        update = lambda c: regression_weight(total, wl, nn, m_total, m_total * c[0] / n_mean, c[k] if free else intercept)
        jk = reweighted(df, [*xs, F.lit(1.0)] if free else xs, y if free else y - intercept, w0, update, block_of(F.col("_i"), n_all, blocks), blocks)
    h2, se, delete = _totals(jk, m, n_mean)
    a, a_se = (float(jk.est[k]), float(jk.se[k])) if intercept is None else (float(intercept), math.nan)
    known = intercept is None and first["y_mean"] > 1
    return Heritability(
        h2, se, a, a_se, first["y_mean"], first["median"] / MEDIAN_CHI2, (a - 1) / (first["y_mean"] - 1) if known else math.nan,
        a_se / (first["y_mean"] - 1) if known else math.nan, delete, jk
    )


@dataclass(frozen=True)
class Partitioned:
    names: list[str]
    m: np.ndarray
    coef: np.ndarray
    coef_se: np.ndarray
    coef_cov: np.ndarray
    h2_parts: np.ndarray
    h2: float
    intercept: float
    n_mean: float
    blocks: int
    jackknife: Jackknife

    @property
    def prop(self) -> np.ndarray:
        return self.h2_parts / self.h2 if abs(self.h2) > 1e-12 else np.full(len(self.names), np.nan)

    def enrichment(self) -> np.ndarray:
        share = self.m / self.m.sum()
        return np.where(share > 1e-12, self.prop / np.where(share > 1e-12, share, 1), np.nan)


def partitioned(
    df: DataFrame, ld: list[str], m: list[float], blocks: int = 200, intercept: float | None = None, chi2: str = "chi2", n: str = "N",
    w: str = "w_l2"
) -> Partitioned:
    """Stratified regression: one weighted fit with the start weights, then the jackknife."""
    y, nn = F.col(chi2), F.col(n)
    total = sum((F.col(c) for c in ld[1:]), F.col(ld[0]))
    m_total = float(sum(m))
    first = df.agg(F.count("*").alias("n"), F.avg(n).alias("n_mean"), F.avg(chi2).alias("y_mean"), F.avg(total * nn).alias("xn")).first()
    n_mean, blocks = first["n_mean"], min(first["n"], blocks)
    start = 1.0 if intercept is None else intercept
    w0 = regression_weight(total, F.col(w), nn, m_total, m_total * (first["y_mean"] - start) / first["xn"], start)
    xs = [F.col(c) * nn / n_mean for c in ld] + ([F.lit(1.0)] if intercept is None else [])
    jk = from_block_sums(*gram(df, xs, y - (intercept or 0.0), w0, block_of(F.col("_i"), first["n"], blocks), blocks))
    k = len(ld)
    coef, mv = jk.est[:k] / n_mean, np.array(m, float)
    cov = jk.cov[:k, :k] / n_mean**2
    return Partitioned(
        list(ld), mv, coef, np.sqrt(np.maximum(np.diag(cov), 0)), cov, coef * mv, float(coef @ mv),
        float(jk.est[k]) if intercept is None else float(intercept), n_mean, blocks, jk
    )


def overlap_results(fit: Partitioned, overlap: np.ndarray, m_tot: int) -> list[dict]:
    """Enrichment of overlapping categories with the test of the difference inside against outside."""
    k = len(fit.names)
    if overlap.shape != (k, k):
        raise ValueError(f"overlap of {overlap.shape} for {k} categories")
    part = fit.m * fit.jackknife.delete[:, :k] / fit.n_mean
    _, prop_cov = ratio(fit.prop, part, np.repeat(part.sum(1, keepdims=True), k, 1))
    share = overlap / fit.m[None, :]
    prop = share @ fit.prop
    prop_se = np.sqrt(np.maximum(np.diag(share @ prop_cov @ share.T), 0))
    prop_m = fit.m / m_tot if m_tot else np.full(k, np.nan)
    rest = m_tot - fit.m
    diff = np.where(
        np.abs(rest[:, None]) < 1e-12, 0.0,
        overlap / fit.m[:, None] - (fit.m[None, :] - overlap) / np.where(np.abs(rest) < 1e-12, 1, rest)[:, None]
    )
    est = diff @ fit.coef
    se = np.sqrt(np.maximum(np.diag(diff @ fit.coef_cov @ diff.T), 0))
    return [
        {
            "category": fit.names[i], "prop_snps": float(prop_m[i]), "prop_h2": float(prop[i]), "prop_h2_se": float(prop_se[i]),
            "enrichment": float(prop[i] / prop_m[i]), "enrichment_se": float(prop_se[i] / prop_m[i]),
            "enrichment_p": None if se[i] == 0 else float(2 * student_t_sf(abs(float(est[i] / se[i])), fit.blocks)),
            "coefficient": float(fit.coef[i]), "coefficient_se": float(fit.coef_se[i]),
            "coefficient_z": float(fit.coef[i] / fit.coef_se[i]) if fit.coef_se[i] else math.nan,
        }
        for i in range(k)
    ]


def cell_types(
    df: DataFrame, sets: list[tuple[str, list[str], list[float]]], base: list[str], m_base: list[float], blocks: int = 200,
    intercept: float | None = None, first: int = 1
) -> list[dict]:
    """For each labelled set of LD columns: its ``first`` coefficients (name, name_1, ...) beside the baseline, one-sided P; ascending P."""
    out = []
    for name, columns, m in sets:
        fit = partitioned(df, [*columns, *base], [*m, *m_base], blocks, intercept)
        for i in range(min(first, len(fit.coef))):
            z = fit.coef[i] / fit.coef_se[i] if fit.coef_se[i] else math.nan
            out.append(
                {
                    "name": f"{name}_{i}" if i else name, "coefficient": float(fit.coef[i]), "coefficient_se": float(fit.coef_se[i]),
                    "p": float(normal_sf(float(z)))
                }
            )
    return sorted(out, key=lambda r: (math.isnan(r["p"]), r["p"]))


@dataclass(frozen=True)
class Covariance:
    rho: float
    se: float
    intercept: float
    intercept_se: float
    mean_z1z2: float
    delete: np.ndarray


def covariance(
    df: DataFrame, ld: list[str], m: list[float], h1: Heritability, h2: Heritability, blocks: int = 200, step: float | None = None,
    intercept: float | None = None
) -> Covariance:
    """Genetic covariance of Z1 and Z2 (columns Z1, Z2, N1, N2)."""
    if step is not None and (intercept is not None or len(ld) > 1):
        raise ValueError("two steps need a free intercept and one LD score column")
    y, n12, wl = F.col("Z1") * F.col("Z2"), F.sqrt(F.col("N1") * F.col("N2")), F.col("w_l2")
    total = sum((F.col(c) for c in ld[1:]), F.col(ld[0]))
    m_total, k = float(sum(m)), len(ld)
    small_mask = (F.col("Z1") * F.col("Z1") < step) & (F.col("Z2") * F.col("Z2") < step) if step is not None else F.lit(False)
    first = df.agg(
        F.count("*").alias("n"), F.avg(n12).alias("n_mean"), F.avg(y).alias("y_mean"), F.avg(total * n12).alias("xn"),
        F.count_if(small_mask).alias("n1")
    ).first()
    n_mean, blocks = first["n_mean"], min(first["n"], blocks)
    start = 0.0 if intercept is None else intercept

    def weight(ld_: Column, rho: float, a: float) -> Column:
        return covariance_weight(ld_, wl, F.col("N1"), F.col("N2"), m_total, h1.h2, h2.h2, rho, a, h1.intercept, h2.intercept)

    w0 = weight(total, m_total * (first["y_mean"] - start) / first["xn"], start)
    xs = [n12 * F.col(c) / n_mean for c in ld]
    if step is not None:
        small, block = df.where(small_mask), moved_blocks(df, small_mask, first["n1"], blocks)
        one = reweighted(small, [*xs, F.lit(1.0)], y, w0, lambda c: weight(xs[0], m_total * c[0] / n_mean, c[1]), block, blocks)
        int1 = float(one.est[1])
        two = reweighted(df, xs, y - int1, w0, lambda c: weight(total, m_total * c[0] / n_mean, int1), block, blocks)
        jk = two_step(one, two, df.agg((F.sum(w0 * xs[0]) / F.sum(w0 * xs[0] * xs[0])).alias("c")).first()["c"])
    else:
        free = intercept is None
        jk = reweighted(
            df, [*xs, F.lit(1.0)] if free else xs, y if free else y - intercept, w0,
            lambda c: weight(total, m_total * c[0] / n_mean, c[k] if free else intercept), block_of(F.col("_i"), first["n"], blocks), blocks
        )
    rho, se, delete = _totals(jk, m, n_mean)
    a, a_se = (float(jk.est[k]), float(jk.se[k])) if intercept is None else (float(intercept), math.nan)
    return Covariance(rho, se, a, a_se, first["y_mean"], delete)


@dataclass(frozen=True)
class Correlation:
    rg: float
    se: float
    z: float
    p: float
    status: str
    h1: Heritability
    h2: Heritability
    gencov: Covariance


def correlation(
    df: DataFrame, ld: list[str], m: list[float], blocks: int = 200, step: float | None = None,
    intercepts: tuple[float | None, float | None, float | None] = (None, None, None), silly: bool = False
) -> Correlation:
    """Genetic correlation of a pair; status says what is out of bounds, the numbers stay raw."""
    both = df.withColumns({"_c1": F.col("Z1") * F.col("Z1"), "_c2": F.col("Z2") * F.col("Z2")})
    h1 = heritability(both, ld, m, blocks, step, intercepts[0], "_c1", "N1")
    h2 = heritability(both, ld, m, blocks, step, intercepts[1], "_c2", "N2")
    cov = covariance(both, ld, m, h1, h2, blocks, step, intercepts[2])
    rg = se = math.nan
    if h1.h2 > 0 and h2.h2 > 0:
        rg = cov.rho / math.sqrt(h1.h2 * h2.h2)
        product = h1.delete * h2.delete
        root = np.where(product >= 0, np.sqrt(np.abs(product)), np.nan)
        se = float(ratio(np.array([rg]), cov.delete[:, None], root[:, None])[0][0])
    z, p = (rg / se, chi2_1_sf((rg / se) ** 2)) if math.isfinite(se) and se else (math.inf, 0.0)
    status = "h2 out of bounds" if h1.h2 <= 0 or h2.h2 <= 0 else "rg out of bounds" if not silly and math.isfinite(rg) and abs(rg) > 1.2 else "ok"
    return Correlation(rg, se, z, p, status, h1, h2, cov)


def resolve_m(given: float | None, files: list[float] | None, n: int, k: int = 1) -> list[float]:
    """M of each LD column. Scalar: the given value, else files, else n. Several: files, else given or n shared out."""
    if k == 1:
        return [float(given)] if given is not None else [float(files[0])] if files else [float(n)]
    if files:
        if len(files) != k:
            raise ValueError(f"{len(files)} values of M for {k} LD score columns")
        return [float(x) for x in files]
    return [(given if given is not None else n) / k] * k
