"""Table operators with row order and strict column rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import kept

#: Bytes of input files, which are packed, for each range of a sort; and from where on a size is no estimate.
RANGE_BYTES, UNKNOWN = 32 << 20, 1 << 50


def ranges_of(df: DataFrame) -> int:
    """How many ranges a sort makes: as many as there are shuffle partitions, more if the input's files are large."""
    least, size, leaves = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        size += int(leaves.apply(i).stats().sizeInBytes())
    return max(least, -(-size // RANGE_BYTES)) if size < UNKNOWN else least


def by_fields(df: DataFrame, order: list[Column]) -> list[Column]:
    """The same order with the fields of structs one after the other: their first sorts by its prefix, a struct has none."""
    out = []
    for c, f in zip(order, df.select(*[c.alias(f"_{i}") for i, c in enumerate(order)]).schema):
        out += [c.getField(x) for x in f.dataType.names] if isinstance(f.dataType, StructType) else [c]
    return out


def in_ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows in the given order: a range shuffle and a sort of each range."""
    order = by_fields(df, order)
    return df.repartitionByRange(parts or ranges_of(df), *order).sortWithinPartitions(*order)


def numbered(
    df: DataFrame, order: list[Column], name: str = "_i", within: list[str] | None = None, total: str | None = None,
    parts: int | None = None, then: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Add the 0-based position of each row in the given order (of each group, if ``within``), and the number of all rows as ``total``.

    A global order is a range shuffle and a sort of each range; a row's number is its place in the
    range plus the rows of the ranges before. The order may be of any sortable type. Ranges are drawn by sampling, so the
    sorted table is kept in the shared folder before they are counted; the counts, a row for each range, are broadcast.
    ``parts`` is the number of ranges, else ``ranges_of``. ``then`` is a projection of the sorted rows; what it leaves out
    isn't kept. A column named _m is the operator's own.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long") - 1)
    rows = kept(then(in_ranges(df, order, parts)).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).cast("int")
    before, counts = 0, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each range
        counts.append((r["p"], before))
        before += r["count"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(counts, "_part int, _before long"))
    out = rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return (out.withColumn(total, F.lit(before).cast("long")) if total else out).drop("_m", "_part", "_before")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are one group. Combines before the shuffle.

    Where the order is of columns of the table, a row is carried once: as what comes first and the rest, of which the least is taken.
    """
    columns, kinds = df.columns, dict(df.dtypes)
    plain = [f.name for f in df.select(*order).schema if kinds.get(f.name) == f.dataType.simpleString()]
    if len(set(plain)) == len(order) and not any(x in k for k in kinds.values() for x in ("map<", "variant", "interval")):
        first = F.min(F.struct(*plain, *[c for c in columns if c not in plain and c not in keys]))
        rows = df.groupBy(*keys).agg(first.alias("_first"))
        return rows.select(*[k for k in keys if k not in plain], "_first.*").select(*columns)
    whole = F.struct(*columns)
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_first")).select("_first.*").select(*columns)


def select(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename; two columns that would share a name are an error."""
    out = [names.get(c, c) for c in df.columns]
    twice = sorted({c for c in out if out.count(c) > 1})
    if twice:
        raise ValueError(f"several columns would be named {', '.join(twice)}")
    return df.toDF(*out)


def side_by_side(left: DataFrame, right: DataFrame, row: str = "_row") -> DataFrame:
    """Columns of both tables, row by row; unequal heights are an error when it is run."""
    mark = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "tables of unequal height")
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), row, "full").withColumn(
        "_ok", F.coalesce(mark.cast("string"), F.lit(""))
    )
    return both.where("_ok = ''").drop("_l", "_r", "_ok")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows, in order of the frames (column ``_part``); names, their order and types must agree."""
    first = frames[0]
    for f in frames[1:]:
        if f.dtypes != first.dtypes:
            raise ValueError(f"columns differ: {f.dtypes} and {first.dtypes}")
    out = first.withColumn("_part", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_part", F.lit(i)))
    return out


def join_first(left: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Inner join where of equal right keys only the first row counts; clashing names get ``_right``. Null never meets."""
    once = first_of(right, [key], order) if order else right.dropDuplicates([key])
    once = once.toDF(*[c if c == key or c not in left.columns else f"{c}_right" for c in once.columns])
    return left.join(once, key)


def merge_aligned(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Tables that list the same keys in the same order are put side by side, repeated and null keys too; others are joined by ``join_first``.

    Without repeated or null keys on the right both give the same, so only then the order is compared.
    """
    n, different = right.agg(F.count("*"), F.count_distinct(key)).first()
    if n != different and left.count() == n:
        one, two = numbered(left, left_order, "_at1"), numbered(right, right_order, "_at2")
        both = one.join(two.withColumnRenamed(key, "_key"), F.col("_at1") == F.col("_at2"))
        if both.where(~F.col(key).eqNullSafe(F.col("_key"))).isEmpty():
            return both.drop("_key", "_at1", "_at2")
    return join_first(left, right, key, right_order)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, sd, min, q25, median, q75, max): exact."""
    parts = [
        F.struct(
            F.lit(name).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
            F.min(c).cast("double").alias("min"),
            *[F.percentile(c, q).alias(a) for q, a in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))], F.max(c).cast("double").alias("max")
        ) for name in columns for c in [F.col(f"`{name}`")]
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair a <= b in the order of the columns; null where a column doesn't vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("r")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("s")).select("s.*")


def drop_constant(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Without the columns of one value over two rows or more; all constant is an error."""
    got = df.agg(*[F.struct(F.count(c), F.min(c), F.max(c)).alias(c) for c in columns]).first()
    kept = [c for c in columns if not (got[c][0] >= 2 and got[c][1] == got[c][2])]
    if not kept:
        raise ValueError("all LD score columns have zero variance")
    return df.drop(*[c for c in columns if c not in kept]), kept


def take_rows(df: DataFrame, places: DataFrame, row: str = "_row") -> DataFrame:
    """Rows by number: ``places`` has ``at`` (a row number) and ``_to``, its new one; repeats are allowed."""
    return df.join(places, df[row] == places["at"]).drop("at", row).withColumnRenamed("_to", row)
