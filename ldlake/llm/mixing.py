"""Mixing sources to target weights by hierarchical budgeting.

Weights are propagated through a domain-language-source tree. A leaf that can't fill its share
(tokens * epochs) leaves a shortage, which goes to its siblings first, in proportion to their weights,
then to the ancestors' siblings. Each leaf then takes a token-prefix of its stream of seeded
epochs: whole epochs are whole copies of the leaf, and only the last, partial one is ordered, by a
hash seeded with the seed and the epoch's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MOST_LEAVES = 200_000
LEVELS = 3  # of eight bits: the order is only made in the 2^-24th of a leaf where its budget ends


def share_out(total: float, weights: dict[str, float], room: dict[str, float]) -> dict[str, float]:
    """Split a total by weight; what one can't take goes to those with room, by weight, until nothing is left or all are full."""
    given = {k: 0.0 for k in room}
    open_ = {k for k in room if room[k] > 0 and weights.get(k, 0) > 0}
    left = total
    while left > 1e-9 and open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + unit * weights[k] >= room[k] - 1e-9}
        if not full:
            for k in open_:
                given[k] += unit * weights[k]
            return given
        for k in full:
            left -= room[k] - given[k]
            given[k] = room[k]
        open_ -= full
    return given


def budgets(leaves: dict[tuple[str, ...], int], total: float, weights: dict[tuple[str, ...], float], epochs: int) -> dict[tuple[str, ...], float]:
    """Budget of each leaf. ``weights`` has a weight for any node, by its path; others have weight 1."""
    out: dict[tuple[str, ...], float] = {}

    def down(prefix: tuple[str, ...], members: dict[tuple[str, ...], int], budget: float) -> None:
        if len(members) == 1 and prefix in members:
            out[prefix] = min(budget, members[prefix] * epochs)
            return
        groups: dict[tuple[str, ...], dict] = {}
        for leaf, tokens in members.items():
            groups.setdefault(leaf[: len(prefix) + 1], {})[leaf] = tokens
        given = share_out(budget, {k: float(weights.get(k, 1.0)) for k in groups}, {k: float(sum(v.values()) * epochs) for k, v in groups.items()})
        for k, v in groups.items():
            down(k, v, given[k])

    if leaves:
        down((), leaves, total)
    return out


def _prefix(docs: DataFrame) -> str:
    """A beginning for columns of the operator's own, that no column of docs has."""
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    return own


def _partial_epochs(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each leaf with a partial epoch (names, at, n, taken): rows before ``at`` in the order are in it, and of the n rows at it ``taken``.

    rows: names, rest (tokens of the partial epoch), t (tokens of the row), o (place in the order).
    Eight bits of the order a time tell where the budget ends; each time a leaf is 256 sums.
    """
    digits = lambda level: F.shiftrightunsigned(F.col("o").bitwiseXOR(F.lit(-(2**63))), 64 - 8 * level)
    w = Window.partitionBy(*names).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("before", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        sums = here.groupBy(*names, "rest", "before", digits(level).alias("digits")).agg(F.sum("t").alias("s"))
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("s").over(w), F.lit(0)))
        cuts = cut(
            sums.where("before < rest").groupBy(*names).agg(
                F.max_by(F.struct("digits", "before"), "digits").alias("cut")
            ).select(*names, F.col("cut.digits").alias("digits"), "cut.before")
        )
        here = rows.join(F.broadcast(cuts), names).where(digits(level) == F.col("digits")).drop("digits")  # a row for each leaf at most
    places = here.groupBy(*names, "rest", "before", "o").agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    inside = Window.partitionBy(*names).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("before", F.col("before") + F.coalesce(F.sum("s").over(inside), F.lit(0))).where("before < rest")
    taken = F.when(F.col("s") == 0, F.col("n")).otherwise(
        F.least("n", F.ceil((F.col("rest") - F.col("before")) * F.col("n") / F.greatest("s", F.lit(1))))
    )
    last = F.max_by(F.struct("o", "n", taken.cast("long").alias("taken")), "o")
    return places.groupBy(*names).agg(last.alias("l")).select(*names, F.col("l.o").alias("at"), "l.n", "l.taken")


def mix(
    docs: DataFrame, path: list[F.Column], tokens: F.Column, key: F.Column, total: float | None = None, share: float = 0.8,
    weights: dict | None = None, epochs: int = 1, seed: int = 11
) -> DataFrame:
    """The rows that the budgets select, once for each epoch they are in, with columns mix_epoch and mix_path.

    ``path`` gives the levels of the tree (null is a node of its own), ``total`` the tokens wanted
    (else ``share`` of all there are). A row is taken while the tokens before it in its leaf's stream
    are below the leaf's budget. The order is that of a seeded hash of the key and of all columns but maps, so only
    rows that are equal tie, and of those as many are taken as the budget wants. Rows without tokens
    go with the order too. A leaf without tokens gives nothing. Leaves are counted in the driver; more than MOST_LEAVES is an error. An
    empty table gives an empty result. Columns of docs named mix_epoch or mix_path are replaced, others may have any names.
    """
    docs = docs.drop("mix_epoch", "mix_path")
    spark, own = docs.sparkSession, _prefix(docs)
    names, t, k, whole, rest, at, n, taken = [f"{own}p{i}" for i in range(len(path))], *(
        f"{own}{x}" for x in ("t", "k", "whole", "rest", "at", "n", "taken")
    )
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.withColumns(
        {c: F.coalesce(p.cast("string"), F.lit("\0null")) for c, p in zip(names, path)} | {
            t: F.coalesce(tokens.cast("long"), F.lit(0).cast("long")), k: F.xxhash64(F.lit(seed), key, *hashed)
        }
    )
    slim = cut(rows.select(*names, t, k))  # the passes over the order read these and no texts
    leaf_rows = slim.groupBy(*names).agg(F.sum(t).alias("s")).limit(MOST_LEAVES + 1).collect()
    if len(leaf_rows) > MOST_LEAVES:
        raise ValueError("too many leaves")
    leaves = {tuple(r[c] for c in names): int(r["s"]) for r in leaf_rows}
    got = budgets(leaves, sum(leaves.values()) * share if total is None else total, weights or {}, epochs)
    plan = [(*leaf, int(got[leaf] // s) if s else 0, float(got[leaf] - (got[leaf] // s) * s) if s else 0.0) for leaf, s in leaves.items()]
    budget = spark.createDataFrame(plan, ", ".join(f"`{c}` string" for c in names) + f", `{whole}` int, `{rest}` double")
    budget = F.broadcast(budget)  # at most MOST_LEAVES rows
    place = F.xxhash64(F.lit(seed), whole, k)
    ordered = slim.join(budget, names).where(F.col(rest) > 0).select(*names, F.col(rest).alias("rest"), F.col(t).alias("t"), place.alias("o"))
    ends = F.broadcast(cut(_partial_epochs(ordered, names)).withColumnsRenamed({"at": at, "n": n, "taken": taken}))
    rows = rows.join(budget, names).join(ends, names, "left")
    tied = F.coalesce((place == F.col(at)) & (F.col(taken) < F.col(n)), F.lit(False))
    more = F.coalesce((place < F.col(at)) | ((place == F.col(at)) & (F.col(taken) == F.col(n))), F.lit(False))
    times = F.col(whole) + more.cast("int")
    full = rows.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    # equal rows at the end of a budget: one of them, as often as it is wanted
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = rows.where(tied).groupBy(*names, whole, taken).agg(F.first(F.struct(*columns, F.lit(0).alias(f"{own}x"))).alias(f"{own}one"))
    one = one.withColumn(f"{own}i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(taken)))).withColumn("mix_epoch", F.col(whole))
    path_text = F.concat_ws("/", *names).alias("mix_path")
    return full.select(*columns, "mix_epoch", path_text).unionByName(
        one.select(*[F.col(f"`{own}one`.`{c}`") for c in docs.columns], "mix_epoch", path_text)
    )
