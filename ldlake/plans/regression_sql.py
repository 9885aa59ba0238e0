"""SQL of regressions for the oracle: closed solutions of normal equations, once for all rows and once without each block.

Each text goes on from a table ``reg`` (SNP, _i, chi2, N, L2, codingL2, w_l2, ...), M being 1000 for L2.
"""

from __future__ import annotations

BLOCKS = 200


def det3(a: list[list[str]]) -> str:
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = a
    return f"({a1} * ({b2} * {c3} - {b3} * {c2}) - {a2} * ({b1} * {c3} - {b3} * {c1}) + {a3} * ({b1} * {c2} - {b2} * {c1}))"


def solved(k: int) -> list[str]:
    """The k unknowns as expressions over s_ij (i <= j) and t_i."""
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    if k == 1:
        return ["t0 / s00"]
    if k == 2:
        whole = "(s00 * s11 - s01 * s01)"
        return [f"(s11 * t0 - s01 * t1) / {whole}", f"(s00 * t1 - s01 * t0) / {whole}"]
    rows = [[s(i, j) for j in range(3)] for i in range(3)]
    return [f"{det3([[f't{i}' if j == c else rows[i][j] for j in range(3)] for i in range(3)])} / {det3(rows)}" for c in range(3)]


def sums(xs: list[str], y: str = "y", w: str = "w") -> str:
    k = range(len(xs))
    return ", ".join([f"sum({w} * {xs[i]} * {xs[j]}) AS s{i}{j}" for i in k for j in k if i <= j] + [f"sum({w} * {xs[i]} * {y}) AS t{i}" for i in k])


def names(k: int) -> list[str]:
    return [f"s{i}{j}" for i in range(k) for j in range(k) if i <= j] + [f"t{i}" for i in range(k)]


def h2_weight(h: str, a: str, scores: str, n: str = "N", m: float = 1000) -> str:
    return f"1 / (2 * power({a} + least(greatest({h}, 0), 1) * {n} / {m} * greatest({scores}, 1), 2)) / greatest(w_l2, 1)"


def cov_weight(rho: str, a: str, h1: str, h2: str, i1: str, i2: str) -> str:
    side = lambda n, h, i: f"({n} * least(greatest({h}, 0), 1) * greatest(L2, 1) / 1000 + {i})"
    return f"1 / ({side('N1', h1, i1)} * {side('N2', h2, i2)} + power(sqrt(N1 * N2) * {rho} * greatest(L2, 1) / 1000 + {a}, 2)) / greatest(w_l2, 1)"


def rounds(tag: str, rows: str, xs: list[str], y: str, weights: list[str]) -> str:
    """Tables {tag}e0 .. with the estimates c0, c1, ... under each weight in turn; a weight may use the estimates before it ({last}); ``given`` is joined."""
    k, text = len(xs), ""
    for step, w in enumerate(weights):
        last = f"{tag}e{step - 1}" if step else "given"
        more = f", {last}" if step else ""
        text += f", {tag}e{step} AS (SELECT {', '.join(f'{e} AS c{i}' for i, e in enumerate(solved(k)))} FROM (SELECT {sums(xs, y)} FROM (SELECT r.*, given.*, {w.replace('{last}', last)} AS w FROM {rows} r, given{more})))"
    return text


def left_out(tag: str, rows: str, xs: list[str], y: str, w: str, last: str, block: str) -> str:
    """Table {tag}d (block, d0, ...): estimates without each block, under the last weight; {tag}f has all rows' (f0, ...)."""
    k = len(xs)
    more = f", {last}" if last != "given" else ""
    text = f", {tag}b AS (SELECT {block} AS block, {sums(xs, y)} FROM (SELECT r.*, given.*, {w.replace('{last}', last)} AS w FROM {rows} r, given{more}) GROUP BY 1)"
    text += f", {tag}a AS (SELECT {', '.join(f'sum({c}) AS a_{c}' for c in names(k))} FROM {tag}b)"
    text += f", {tag}l AS (SELECT q.block, {', '.join(f'a_{c} - coalesce({c}, 0) AS {c}' for c in names(k))} FROM (SELECT range AS block FROM range({BLOCKS})) q CROSS JOIN {tag}a LEFT JOIN {tag}b USING (block))"
    text += f", {tag}d AS (SELECT block, {', '.join(f'{e} AS d{i}' for i, e in enumerate(solved(k)))} FROM {tag}l)"
    text += f", {tag}f AS (SELECT {', '.join(f'{e} AS f{i}' for i, e in enumerate(solved(k)))} FROM (SELECT {', '.join(f'a_{c} AS {c}' for c in names(k))} FROM {tag}a))"
    return text


def spread(value: str) -> str:
    """Standard error out of pseudovalues (an expression) of all blocks."""
    return f"sqrt(var_samp({value}) / {BLOCKS})"


def pseudo(est: str, out: str) -> str:
    return f"({BLOCKS} * {est} - {BLOCKS - 1} * ({out}))"


BLOCK = f"CAST(((_i + 1) * {BLOCKS} - 1) // cnt AS BIGINT)"


def two_step(reg: str) -> str:
    start = h2_weight("h0", "1", "L2")
    one, two = h2_weight("1000 * c0 / nb", "c1", "N * L2 / nb"), h2_weight("1000 * {last}.c0 / nb", "int1", "L2")
    x = "N * L2 / nb"
    text = reg + ", given AS (SELECT avg(N) AS nb, 1000 * (avg(chi2) - 1) / avg(L2 * N) AS h0, avg(chi2) AS mean, median(chi2) AS med FROM reg)"
    text += ", small AS (SELECT *, row_number() OVER (ORDER BY _i) - 1 AS k FROM reg WHERE chi2 < 30)"
    text += f", borders AS (SELECT _i AS edge FROM small JOIN (SELECT range * (SELECT count(*) FROM small) // {BLOCKS} AS k FROM range(1, {BLOCKS})) USING (k))"
    text += ", placed AS (SELECT reg.*, (SELECT count(*) FROM borders WHERE edge <= reg._i) AS moved FROM reg), few AS (SELECT * FROM placed WHERE chi2 < 30)"
    text += rounds("o", "few", [x, "1"], "chi2", [start, one]) + left_out("o", "few", [x, "1"], "chi2", one, "oe1", "moved")
    text += ", more AS (SELECT placed.*, chi2 - f1 AS y2, f1 AS int1 FROM placed, of)"
    text += rounds("p", "more", [x], "y2", [start, two]) + left_out("p", "more", [x], "y2", two, "pe1", "moved")
    text += f", cc AS (SELECT sum(w * x) / sum(w * x * x) AS c FROM (SELECT {start} AS w, {x} AS x FROM reg, given))"
    text += ", dd AS (SELECT pd.d0 - c * (od.d1 - of.f1) AS slope, od.d1 AS icept FROM pd JOIN od USING (block), cc, of)"
    text += f", se AS (SELECT {spread(pseudo('pf.f0', 'slope'))} AS s0, {spread(pseudo('of.f1', 'icept'))} AS s1 FROM dd, pf, of)"
    return text + """ SELECT round(1000 * pf.f0 / nb, 5) AS h2, round(1000 * s0 / nb, 5) AS h2_se, round(of.f1, 5) AS intercept, round(s1, 5) AS intercept_se, round(mean, 5) AS mean_chi2,
        round(med / 0.4549, 5) AS lambda_gc, CASE WHEN mean > 1 THEN round((of.f1 - 1) / (mean - 1), 5) END AS ratio, CASE WHEN mean > 1 THEN round(s1 / (mean - 1), 5) END AS ratio_se FROM given, pf, of, se"""


def partitioned(reg: str, columns: list[str], m: list[float | str], tag: str = "q", rows: str = "reg", given: str = "") -> str:
    """Tables {tag}d and {tag}f of the regression on several LD columns and an intercept; ``given`` has nb, h0 and the values of M that are texts."""
    total, m_total = f"({' + '.join(columns)})", f"({' + '.join(map(str, m))})"
    text = reg + f", given AS (SELECT avg(N) AS nb, count(*) AS cnt, {m_total} * (avg(chi2) - 1) / avg({total} * N) AS h0{given} FROM {rows})"
    xs = [*(f"{c} * N / nb" for c in columns), "1"]
    return text + left_out(tag, rows, xs, "chi2", h2_weight("h0", "1", total, m=m_total), "given", BLOCK)


def categories(reg: str) -> str:
    text = partitioned(reg, ["L2", "codingL2"], [1000, 400])
    text += f", se AS (SELECT {spread(pseudo('f0 / nb', 'd0 / nb'))} AS e0, {spread(pseudo('f1 / nb', 'd1 / nb'))} AS e1 FROM qd, qf, given)"
    part = "SELECT '{c}' AS category, round({m} * f{i} / (1000 * f0 + 400 * f1), 5) AS prop_h2, round({m} * f{i} / (1000 * f0 + 400 * f1) / ({m} / 1400.0), 5) AS enrichment, round(f{i} / nb * 1000, 7) AS coefficient_1000, round(e{i} * 1000, 7) AS coefficient_se_1000 FROM qf, given, se"
    return text + " " + " UNION ALL ".join(part.format(c=c, m=m, i=i) for i, (c, m) in enumerate((("L2", 1000), ("codingL2", 400))))


def overlapping(reg: str) -> str:
    """Categories base (all SNPs) and coding, whose overlap is that of the annotations with 0.05 < FRQ < 0.95."""
    counts = "(SELECT CAST(count(*) AS DOUBLE) FROM v_annot WHERE FRQ > 0.05 AND FRQ < 0.95{0})"
    ma, mb, tot = counts.format(""), counts.format(" AND coding = 1"), "(SELECT CAST(count(*) AS DOUBLE) FROM v_annot)"
    text = partitioned(reg, ["L2", "codingL2"], [ma, mb], given=f", {ma} AS ma, {mb} AS mb, {tot} AS tot")
    text += ", pv AS (SELECT ma * d0 / (ma * d0 + mb * d1) AS qa, mb * d1 / (ma * d0 + mb * d1) AS qb FROM qd, given), p AS (SELECT ma * f0 / (ma * f0 + mb * f1) AS pa, mb * f1 / (ma * f0 + mb * f1) AS pb FROM qf, given)"
    text += f", zz AS (SELECT {pseudo('pa', 'qa')} AS za, {pseudo('pb', 'qb')} AS zb FROM pv, p), c AS (SELECT var_samp(za) / {BLOCKS} AS vaa, var_samp(zb) / {BLOCKS} AS vbb, covar_samp(za, zb) / {BLOCKS} AS vab FROM zz)"
    text += f", se AS (SELECT {spread(pseudo('f0 / nb', 'd0 / nb'))} AS e0, {spread(pseudo('f1 / nb', 'd1 / nb'))} AS e1 FROM qd, qf, given)"
    # coding lies inside base, so their overlap is coding's size
    text += ", o AS (SELECT 'L2' AS category, ma / tot AS prop_snps, ma / ma AS ra, mb / mb AS rb, f0 / nb AS f, e0 AS e FROM given, qf, se UNION ALL SELECT 'codingL2', mb / tot, mb / ma, mb / mb, f1 / nb, e1 FROM given, qf, se)"
    return text + """ SELECT category, round(prop_snps, 6) AS prop_snps, round(ra * pa + rb * pb, 5) AS prop_h2, round(sqrt(greatest(ra * ra * vaa + 2 * ra * rb * vab + rb * rb * vbb, 0)), 5) AS prop_h2_se,
        round((ra * pa + rb * pb) / prop_snps, 5) AS enrichment, round(sqrt(greatest(ra * ra * vaa + 2 * ra * rb * vab + rb * rb * vbb, 0)) / prop_snps, 5) AS enrichment_se,
        round(f * 1000, 7) AS coefficient_1000, round(e * 1000, 7) AS coefficient_se_1000, round(f / e, 5) AS coefficient_z FROM o, p, c"""


def cell_types(reg: str) -> str:
    """A regression for each of two sets of scores, each beside the baseline."""
    text = reg + ", cts AS (SELECT *, codingL2 * (_i % 3) AS tissueL2 FROM reg)"
    parts = []
    for tag, (name, m) in zip("uv", (("coding", 400), ("tissue", 300))):
        body = partitioned("", [f"{name}L2", "L2"], [m, 1000], tag, "cts").replace("given", f"given{tag}")
        text += body
        parts.append(
            f"SELECT '{name}' AS name, round({tag}f.f0 / nb * 1000, 7) AS coefficient_1000, round(any_value(se) * 1000, 7) AS coefficient_se_1000 FROM {tag}f, given{tag}, (SELECT {spread(pseudo('f0 / nb', 'd0 / nb'))} AS se FROM {tag}d, {tag}f, given{tag}) GROUP BY {tag}f.f0, nb"
        )
    return text + " " + " UNION ALL ".join(parts)


def correlation(reg: str) -> str:
    """One-step regressions of both traits and of their product, and the jackknife of the ratio."""
    text = reg + ", pair AS (SELECT _i, Z * sqrt(1 + L2 / 5) AS z1, 0.6 * (Z * sqrt(1 + L2 / 5)) + sin(_i) AS z2, N AS N1, N + 100 AS N2, L2, w_l2 FROM reg), two AS (SELECT *, z1 * z1 AS y1, z2 * z2 AS y2, z1 * z2 AS y3, sqrt(N1 * N2) AS N3 FROM pair)"
    text += ", given AS (SELECT count(*) AS cnt, avg(N1) AS b1, avg(N2) AS b2, avg(N3) AS b3, 1000 * (avg(y1) - 1) / avg(L2 * N1) AS g1, 1000 * (avg(y2) - 1) / avg(L2 * N2) AS g2, 1000 * avg(y3) / avg(L2 * N3) AS g3, avg(y3) AS mean FROM two)"
    for t in "12":
        x, start, w = f"N{t} * L2 / b{t}", h2_weight(f"g{t}", "1", "L2", f"N{t}"), h2_weight(f"1000 * c0 / b{t}", "c1", "L2", f"N{t}")
        text += rounds(f"h{t}", "two", [x, "1"], f"y{t}", [start, w]) + left_out(f"h{t}", "two", [x, "1"], f"y{t}", w, f"h{t}e1", BLOCK)
    text += ", three AS (SELECT two.*, 1000 * h1f.f0 / b1 AS e1, h1f.f1 AS i1, 1000 * h2f.f0 / b2 AS e2, h2f.f1 AS i2 FROM two, h1f, h2f, given)"
    x, start, w = "N3 * L2 / b3", cov_weight("g3", "0", "e1", "e2", "i1", "i2"), cov_weight("(1000 * c0 / b3)", "c1", "e1", "e2", "i1", "i2")
    text += rounds("k", "three", [x, "1"], "y3", [start, w]) + left_out("k", "three", [x, "1"], "y3", w, "ke1", BLOCK)
    text += ", est AS (SELECT 1000 * h1f.f0 / b1 AS e1, 1000 * h2f.f0 / b2 AS e2, 1000 * kf.f0 / b3 AS rho, kf.f1 AS a, mean FROM h1f, h2f, kf, given)"
    text += ", outs AS (SELECT (1000 * kd.d0 / b3) / sqrt((1000 * h1d.d0 / b1) * (1000 * h2d.d0 / b2)) AS q FROM kd JOIN h1d USING (block) JOIN h2d USING (block), given)"
    text += f", se AS (SELECT {spread(pseudo('rho / sqrt(e1 * e2)', 'q'))} AS s FROM outs, est)"
    return text + """ SELECT round(rho / sqrt(e1 * e2), 5) AS rg, round(s, 5) AS se, round(rho / sqrt(e1 * e2) / s, 4) AS z, round(e1, 5) AS h2_1, round(e2, 5) AS h2_2,
        round(rho, 5) AS gcov, round(a, 5) AS gcov_int, round(mean, 5) AS mean_z1z2 FROM est, se"""
