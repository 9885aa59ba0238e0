"""Column builders: everything here is an expression that stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the published rational approximations PPND16 (Wichura 1988, AS 241),
#: highest power first; the last denominator coefficient is 1.
CENTRE_NUM = (
    "2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457", "13731.693765509461125",
    "1971.5909503065514427", "133.14166789178437745", "3.387132872796366608"
)
CENTRE_DEN = (
    "5226.495278852854561", "28729.085735721942674", "39307.89580009271061", "21213.794301586595867", "5394.1960214247511077",
    "687.1870074920579083", "42.313330701600911252", "1.0"
)
MID_NUM = (
    "7.7454501427834140764e-4", "0.0227238449892691845833", "0.24178072517745061177", "1.27045825245236838258", "3.64784832476320460504",
    "5.7694972214606914055", "4.6303378461565452959", "1.42343711074968357734"
)
MID_DEN = (
    "1.05075007164441684324e-9", "5.475938084995344946e-4", "0.0151986665636164571966", "0.14810397642748007459", "0.68976733498510000455",
    "1.6763848301838038494", "2.05319162663775882187", "1.0"
)
TAIL_NUM = (
    "2.01033439929228813265e-7", "2.71155556874348757815e-5", "0.0012426609473880784386", "0.026532189526576123093",
    "0.29656057182850489123", "1.7848265399172913358", "5.4637849111641143699", "6.6579046435011037772"
)
TAIL_DEN = (
    "2.04426310338993978564e-15", "1.4215117583164458887e-7", "1.8463183175100546818e-5", "7.868691311456132591e-4",
    "0.0148753612908506148525", "0.13692988092273580531", "0.59983220655588793769", "1.0"
)

NA_TOKENS = ("", "na", ".", "nan")


def _horner(coefficients: tuple[str, ...], x: str) -> str:
    text = f"CAST({coefficients[0]} AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c} AS DOUBLE))"
    return text


def probit_sql(p: str) -> str:
    """SQL text of |inverse normal cdf of p/2|, p clamped to [1e-300, 1]; the same text runs in other engines."""
    half = f"(least(greatest({p}, CAST(1e-300 AS DOUBLE)), CAST(1.0 AS DOUBLE)) / CAST(2.0 AS DOUBLE))"
    q = f"({half} - CAST(0.5 AS DOUBLE))"
    centre = f"(CAST(0.180625 AS DOUBLE) - {q} * {q})"
    root = f"sqrt(-ln({half}))"
    mid, tail = f"({root} - CAST(1.6 AS DOUBLE))", f"({root} - CAST(5.0 AS DOUBLE))"
    ratio = lambda num, den, x: f"{_horner(num, x)} / {_horner(den, x)}"
    return (
        f"CASE WHEN abs({q}) <= CAST(0.425 AS DOUBLE) THEN abs({q} * {ratio(CENTRE_NUM, CENTRE_DEN, centre)}) "
        f"WHEN {root} <= CAST(5.0 AS DOUBLE) THEN {ratio(MID_NUM, MID_DEN, mid)} ELSE {ratio(TAIL_NUM, TAIL_DEN, tail)} END"
    )


def probit(p: str) -> Column:
    """|Z| of a two-sided P value held in the column named ``p``; for many rows ``with_probit`` does the same in smaller code."""
    return F.expr(probit_sql(p))


def with_probit(df: DataFrame, p: str, name: str) -> DataFrame:
    """Add |Z| of a two-sided P value. What the formula needs more than once is a column of its own, computed once.

    Inside, nothing is nullable (a missing P is put back at the end): without null checks the generated code
    is small enough to be compiled.
    """

    def polynomial(coefficients: tuple[str, ...], x: Column) -> Column:
        out = F.lit(float(coefficients[0]))
        for c in coefficients[1:]:
            out = out * x + F.lit(float(c))
        return out

    ratio = lambda num, den, x: polynomial(num, x) / polynomial(den, x)
    half, q, root, arg = (f"_{name}_{x}" for x in ("half", "q", "root", "arg"))
    df = df.withColumn(half, F.least(F.greatest(F.col(p), F.lit(1e-300)), F.lit(1.0)) / F.lit(2.0))
    df = df.withColumns({q: F.col(half) - F.lit(0.5), root: F.coalesce(F.sqrt(-F.log(half)), F.lit(0.0))})
    centre, mid = F.abs(q) <= F.lit(0.425), F.col(root) <= F.lit(5.0)
    df = df.withColumn(
        arg, F.when(centre, F.lit(0.180625) - F.col(q) * F.col(q)).when(mid, F.col(root) - F.lit(1.6)).otherwise(F.col(root) - F.lit(5.0))
    )
    x = F.col(arg)
    value = F.when(
        centre, F.abs(F.col(q) * ratio(CENTRE_NUM, CENTRE_DEN, x))
    ).when(mid, ratio(MID_NUM, MID_DEN, x)).otherwise(ratio(TAIL_NUM, TAIL_DEN, x))
    return df.withColumn(name, F.when(F.col(p).isNotNull(), value)).drop(half, q, root, arg)


def number(c: Column) -> Column:
    """A cell as double: NA tokens (any case, trimmed), NaN and what doesn't parse become null. The cell is parsed once."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))  # none of the NA tokens parses, but NaN


def is_word(c: Column) -> Column:
    """Whether a trimmed cell begins as no number does; to tell so is cheaper than to try and parse it."""
    first = F.ascii(c)
    return (first.between(65, 90) | first.between(97, 122)) & ~F.lower(c).isin("inf", "infinity", "nan")


def numeric(df: DataFrame, name: str) -> Column:
    """``number`` of a column of df; what is a number already isn't written as text first."""
    kind = next(k for c, k in df.dtypes if c == name)
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("double"))
    return number(c) if kind == "string" else c.cast("double")


def integer_or_zero(c: Column, kind: str = "long") -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def valid_alleles(a1: Column, a2: Column) -> Column:
    """Both in ACGT, different, and not a strand-ambiguous pair."""
    return a1.isin(*"ACGT") & a2.isin(*"ACGT") & (a1 != a2) & (complement(a1) != a2)


def same_or_flipped(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """+1 for the same pair on either strand, -1 for the swapped pair on either strand, else null."""
    c1, c2 = complement(a1), complement(a2)
    same = ((a1 == b1) & (a2 == b2)) | ((c1 == b1) & (c2 == b2))
    swap = ((a1 == b2) & (a2 == b1)) | ((c1 == b2) & (c2 == b1))
    return F.when(same, 1).when(swap, -1)


def chi_square(z: Column) -> Column:
    return z * z


def regression_weight(ld: Column, w_ld: Column, n: Column, m: float, h2: float, intercept: float) -> Column:
    """1 / (2 (intercept + h2 n ld / m)^2 max(w_ld, 1)), h2 clamped to [0, 1] and ld to 1 at least."""
    c = min(max(h2, 0.0), 1.0)
    variance = F.lit(float(intercept)) + F.lit(c) * n / F.lit(float(m)) * F.greatest(ld, F.lit(1.0))
    return 1 / (2 * variance * variance) / F.greatest(w_ld, F.lit(1.0))


def covariance_weight(
    ld: Column, w_ld: Column, n1: Column, n2: Column, m: float, h1: float, h2: float, rho: float, int_g: float, int1: float, int2: float
) -> Column:
    """Weight of a cross-trait product; both heritabilities are clamped to [0, 1], rho isn't clamped."""
    x = F.greatest(ld, F.lit(1.0))
    side = lambda n, h, i: n * F.lit(min(max(h, 0.0), 1.0)) * x / F.lit(float(m)) + F.lit(float(i))
    cross = F.sqrt(n1 * n2) * F.lit(float(rho)) * x / F.lit(float(m)) + F.lit(float(int_g))
    return 1 / (side(n1, h1, int1) * side(n2, h2, int2) + cross * cross) / F.greatest(w_ld, F.lit(1.0))


def unbiased_r2(r: Column, n: int) -> Column:
    """r^2 - (1 - r^2) / (n - 2), with n where n <= 2."""
    return unbiased(r * r, n)


def unbiased(r2: Column, n: int) -> Column:
    return r2 - (1 - r2) / F.lit(float(n - 2 if n > 2 else n))


def sketch_r2(t: Column, d: Column) -> Column:
    """Bias correction of a squared correlation ``t`` in ``d`` sketch dimensions: the quadratic's root, 0 without one."""
    disc = (d - 3) * (d - 3) + 8 * (d * t - 1)
    return F.when(disc < 0, 0.0).otherwise((-(d - 3) + F.sqrt(F.greatest(disc, F.lit(0.0)))) / 4)


def float_text(c: Column) -> Column:
    """Three decimals, trailing zeros dropped but one; null is empty.

    Numbers of a common size are cast to decimals, which gives the digits of the format in less time. A table has many
    such columns in one projection, so this is kept short: longer code would not be compiled.
    """
    x = c.cast("double")
    fixed = F.when(F.abs(x).between(0.001, 1e14), x.cast("decimal(18,3)").cast("string")).otherwise(F.format_string("%.3f", x))
    return F.when(c.isNull() | F.isnan(x), "").otherwise(F.regexp_replace(F.rtrim(fixed, F.lit("0")), r"\.$", ".0"))
