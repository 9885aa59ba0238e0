"""Text tables of the field: separators, compression, chromosome-split files and their sidecars.

Every reader gives string columns and ``_row``, the place in the file order, which later stages rely on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NA_TOKENS, integer_or_zero, is_word, number
from . import members

CHROMOSOMES = range(1, 23)
SUFFIXES = (".gz", ".bz2", "")


def paths(text: str) -> list[str]:
    """A comma-separated list, trimmed, without empty parts."""
    return [p.strip() for p in text.split(",") if p.strip()]


def chromosome_path(prefix: str, chromosome: int, suffix: str = "") -> str:
    """The prefix with ``@`` replaced by the chromosome, else with the chromosome appended."""
    return (prefix.replace("@", str(chromosome)) if "@" in prefix else f"{prefix}{chromosome}") + suffix


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path, as the cluster sees it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p.makeQualified(fs.getUri(), fs.getWorkingDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def present(spark: SparkSession, prefix: str, suffix: str, every: bool = False) -> list[int]:
    """Chromosomes 1 to 22 that have a file, which are those of regressions; ``every`` number that has one, if asked for."""
    return [c for c in (_numbered_files(spark, prefix, suffix) if every else CHROMOSOMES) if exists(spark, chromosome_path(prefix, c, suffix))]


def _numbered_files(spark: SparkSession, prefix: str, suffix: str) -> list[int]:
    """Numbers that stand for the chromosome in some path; the first name of the path that has one is listed."""
    text = prefix if "@" in prefix else f"{prefix}@"
    folder, slash, rest = text[: text.index("@")].rpartition("/")
    name = re.escape(rest) + "(0|[1-9][0-9]*)" + re.escape((text + suffix)[text.index("@") + 1 :].partition("/")[0].partition("@")[0])
    fs, p = _hadoop(spark, folder or slash or ".")
    if not fs.exists(p):
        return []
    return sorted({int(m[1]) for x in fs.listStatus(p) if (m := re.match(name, x.getPath().getName()))})


def _bare(path: str) -> str:
    """A path without the ways in which a local scheme is written."""
    return re.sub(r"^file:/+", "/", path)


def _ordered(df: DataFrame, names: list[str]) -> DataFrame:
    """Add ``_row``: file by the order given (whole paths), part of it if it is a folder, place in that (block start, then line of the block)."""
    at = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    file, part = F.lit(len(names)), F.lit("")
    for i, name in reversed(list(enumerate(names))):
        inside = F.startswith(at, F.lit(name + "/"))
        file = F.when((at == name) | inside, F.lit(i)).otherwise(file)
        part = F.when(inside, F.substring(at, len(name) + 2, 1 << 20)).otherwise(part)
    return df.withColumn(
        "_row",
        F.struct(file.alias("f"), part.alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    )


def _unpacked_lines(spark: SparkSession, files: list[tuple[int, str]], skip: int) -> DataFrame:
    """Lines of block-gzip files, which are gzip files of many members: a task streams a file."""

    def read(batches):
        import io

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for i, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression="gzip") as f:
                    text, left = io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8", newline=None), skip
                    number, values = 0, []
                    for line in text:
                        number += 1
                        line = line.rstrip("\n")
                        if left and line.strip():
                            left -= 1
                            continue
                        values.append((line, {"f": i, "p": "", "b": 0, "m": number}))
                        if len(values) == 10_000:
                            yield pa.RecordBatch.from_pylist([{"value": v, "_row": r} for v, r in values], schema)
                            values = []
                    if values:
                        yield pa.RecordBatch.from_pylist([{"value": v, "_row": r} for v, r in values], schema)

    import pyarrow as pa

    schema = pa.schema([("value", pa.string()), ("_row", pa.struct([("f", pa.int32()), ("p", pa.string()), ("b", pa.int64()), ("m", pa.int64())]))])
    table = spark.createDataFrame(files, "i int, path string").repartition(len(files), "path")
    return table.mapInArrow(read, "value string, _row struct<f:int,p:string,b:bigint,m:bigint>")


def _shared_out(spark: SparkSession, files: list[str], names: list[str]) -> tuple[list[tuple[int, str, int, int]], set[int]]:
    """Of large gzip files, (number, path, start, bytes) of those that tasks can share, and the numbers of those that are one stream."""
    parts, streams = [], set()
    for i, f in enumerate(files):
        fs, p = _hadoop(spark, f)
        if not f.endswith(".gz") or not fs.getFileStatus(p).isFile() or fs.getFileStatus(p).getLen() < 2 * members.RANGE:
            continue
        path = _bare(names[i])
        try:
            members.opened(path)
            found = members.ranges(spark, fs, p)
        except (OSError, ValueError):  # a file system that only the cluster knows
            found = None
        if found is None:
            streams.add(i)
        else:
            parts += [(i, path, *r) for r in found]
    return parts, streams


def lines(spark: SparkSession, files: str | list[str], header: bool = False) -> DataFrame:
    """(value, _row) of non-blank lines, without the first of each file if it is a ``header``; .gz, .bgz and .bz2 are unpacked.

    Large gzip files are read by many tasks if their members tell their lengths, as those of ``write_table`` do.
    Others are one stream; its lines are dealt out before anything is done with them.
    """
    files = [files] if isinstance(files, str) else files
    names = [_hadoop(spark, f)[1].toString() for f in files]
    blocked = [(i, "file://" + _bare(n) if n.startswith("file:") else n) for i, n in enumerate(names) if n.endswith(".bgz")]
    shared, streams = _shared_out(spark, files, names)
    plain = [f for i, f in enumerate(files) if not f.endswith(".bgz") and i not in {x[0] for x in shared}]
    out = members.lines(spark, shared, header) if shared else None
    if plain:
        # one column up to a character that no table has; this reader leaves out each file's first line
        rows = spark.read.schema("value string").csv(
            plain, sep="\x01", header=header, quote="", escape="", comment="", nullValue="\x01", ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1
        ) if header else spark.read.text(plain)
        rows = _ordered(rows, [_bare(n) for n in names]).select("value", "_row")
        rows = rows.repartition(F.col("_row.m")) if streams else rows
        out = rows if out is None else out.unionByName(rows)
    if blocked:
        more = _unpacked_lines(spark, blocked, int(header))
        out = more if out is None else out.unionByName(more)
    return out.where(F.trim("value") != "")


def first_line(spark: SparkSession, path: str) -> str:
    """The first non-blank line, read in the driver; of a folder, that of its first part."""
    jvm, (fs, p) = spark.sparkContext._jvm, _hadoop(spark, path)
    if fs.getFileStatus(p).isDirectory():
        parts = sorted(x.getPath().toString() for x in fs.listStatus(p) if x.isFile() and x.getPath().getName()[0] not in "._")
        p = jvm.org.apache.hadoop.fs.Path(parts[0]) if parts else p
    conf, stream = spark.sparkContext._jsc.hadoopConfiguration(), fs.open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    if codec is None and path.endswith(".bgz"):
        codec = jvm.org.apache.hadoop.io.compress.GzipCodec()
        codec.setConf(conf)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            if line.strip():
                return line
    finally:
        reader.close()
    raise ValueError(f"{path} is empty")


def _cells(header: str) -> Column:
    """The separator is told from the header: tab if it has one, else runs of white space."""
    return F.split("value", "\t", -1) if "\t" in header else F.split(F.trim("value"), r"\s+")


def names_of(header: str) -> list[str]:
    return header.rstrip("\r\n").split("\t") if "\t" in header else header.split()


def cell(c: Column) -> Column:
    """A cell as trimmed text; what stands for a missing value (empty, NA, a dot, NaN) is null."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin(*NA_TOKENS), text)


def read_table(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """A table with a header, as strings, missing cells null; short rows are filled with nulls; no quoting.

    Several files must have the same columns; each one's first line is its header.
    """
    files = [files] if isinstance(files, str) else files
    header = first_line(spark, files[0])
    names = [n.strip() for n in names_of(header)]
    for f in files[1:]:
        if [n.strip() for n in names_of(first_line(spark, f))] != names:
            raise ValueError(f"{f} has other columns than {files[0]}")
    rows = lines(spark, files, True).select(_cells(header).alias("c"), "_row")
    return rows.select(*[cell(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(names)], "_row")


read_sumstats = read_ld = read_table


def typed(df: DataFrame) -> DataFrame:
    """Columns as doubles where every cell that isn't missing is a number; one aggregation over the table."""
    names = [c for c in df.columns if c != "_row"]
    cells = [F.col(f"`{c}`") for c in names]
    bad = df.agg(*[F.count_if(c.isNotNull() & (is_word(c) | number(c).isNull())).alias(f"b{i}") for i, c in enumerate(cells)]).first()
    return df.withColumns({c: number(F.col(f"`{c}`")) for i, c in enumerate(names) if bad[i] == 0})


def read_split(spark: SparkSession, prefix: str, suffix: str, every: bool = False) -> DataFrame:
    """Chromosome files in order, of 1 to 22 or of ``every`` number; the first of .gz, .bz2 and plain that has any wins."""
    for packed in SUFFIXES:
        found = present(spark, prefix, suffix + packed, every)
        if found:
            return read_table(spark, [chromosome_path(prefix, c, suffix + packed) for c in found])
    raise FileNotFoundError(f"no files for {prefix} with {suffix}")


def _numbers(spark: SparkSession, path: str) -> list[float]:
    return [float(x) for x in first_line(spark, path).split()]


def m_vector(spark: SparkSession, prefixes: list[str], split: bool, common: bool = True) -> list[float]:
    """Values of the M sidecars: summed over chromosomes, prefixes one after the other; lengths must agree."""
    suffix = ".l2.M_5_50" if common else ".l2.M"
    out: list[float] = []
    for prefix in prefixes:
        files = [chromosome_path(prefix, c, suffix) for c in present(spark, prefix, suffix)] if split else [prefix + suffix]
        values = [_numbers(spark, f) for f in files]
        if not values:
            raise FileNotFoundError(f"no M files of {prefix}")
        if len({len(v) for v in values}) != 1:
            raise ValueError(f"M files of {prefix} differ in length")
        out += [sum(v) for v in zip(*values)]
    return out


def m_total(spark: SparkSession, prefix: str, common: bool = True) -> float:
    suffix = ".l2.M_5_50" if common else ".l2.M"
    return sum(_numbers(spark, chromosome_path(prefix, c, suffix))[0] for c in present(spark, prefix, suffix))


def annotation_path(spark: SparkSession, prefix: str) -> str:
    """The path itself if it names an annotation file, else with .annot and each compression."""
    if re.search(r"\.annot(\.gz|\.bz2)?$", prefix):
        return prefix
    for packed in SUFFIXES:
        if exists(spark, f"{prefix}.annot{packed}"):
            return f"{prefix}.annot{packed}"
    raise FileNotFoundError(f"no annotation for {prefix}")


def read_annotation(spark: SparkSession, path: str | list[str], thin: bool = False) -> tuple[DataFrame, list[str]]:
    """Annotation columns as doubles, missing as 0; a full file's first four columns are skipped by place. Several files follow one another."""
    df = read_table(spark, path)
    names = [c for c in df.columns if c != "_row"][0 if thin else 4 :]
    return df.select(*[F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in names], "_row"), names


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """FRQ (column FRQ or MAF) and ``common``: 0.05 < FRQ < 0.95, false where missing."""
    df = read_table(spark, path)
    name = next((c for c in df.columns if c.upper() in ("FRQ", "MAF")), None)
    if name is None:
        raise ValueError(f"{path} has neither FRQ nor MAF")
    f = number(F.col(name))
    return df.select(f.alias("FRQ"), F.coalesce((f > 0.05) & (f < 0.95), F.lit(False)).alias("common"), "_row")


def read_bim(spark: SparkSession, path: str, chromosomes: list[int] | None = None) -> DataFrame:
    """CHR, SNP, CM, BP, bed_idx; numbers that don't parse are 0. The index counts every line, whatever is kept."""
    from ..operators.frames import numbered

    c = F.split("value", "\t", -1)
    rows = lines(spark, path).select(
        integer_or_zero(c[0], "int").alias("CHR"), F.get(c, F.lit(1)).alias("SNP"),
        F.coalesce(F.get(c, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("CM"), integer_or_zero(F.get(c, F.lit(3))).alias("BP"),
        F.size(c).alias("_n"), "_row"
    )
    rows = rows.where(F.assert_true(F.col("_n") >= 6, "a BIM line needs six tab-separated fields").isNull()).drop("_n")
    rows = numbered(rows, [F.col("_row")], "bed_idx")
    return rows.where(F.col("CHR").isin(*chromosomes)) if chromosomes else rows


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """FID, IID, iid_idx of each line."""
    from ..operators.frames import numbered

    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).select(F.get(c, F.lit(0)).alias("FID"), F.get(c, F.lit(1)).alias("IID"), "_row")
    return numbered(rows, [F.col("_row")], "iid_idx").drop("_row")


def keep_people(fam: DataFrame, listed: DataFrame) -> list[int]:
    """Indices of people on the list (FID, IID), in file order; none is an error."""
    got = [r[0] for r in fam.join(listed, ["FID", "IID"], "left_semi").select("iid_idx").orderBy("iid_idx").collect()]
    if not got:
        raise ValueError("no individuals are left")
    return got


def read_keep(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where(~F.trim("value").startswith("#")).select(c[0].alias("FID"), F.get(c, F.lit(1)).alias("IID"))


def read_snp_list(spark: SparkSession, path: str, one_column: bool = False) -> DataFrame:
    """SNP ids, first token of each line; ``one_column`` makes further tokens an error."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(~F.trim("value").startswith("#"))
    if one_column:
        rows = rows.where(F.assert_true(F.size(c) == 1, "a SNP list must have one column").isNull())
    return rows.select(c[0].alias("SNP")).distinct()


def read_ldcts(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(label, prefixes) of each line; exactly two columns."""
    out = []
    for row in lines(spark, path).orderBy("_row").collect():  # a line for each regression to run
        parts = row["value"].split()
        if len(parts) != 2:
            raise ValueError(f"two columns expected: {row['value']}")
        out.append((parts[0], paths(parts[1])))
    return out


def read_cts(spark: SparkSession, path: str, bim: DataFrame) -> DataFrame:
    """Values of a continuous annotation joined to the BIM; ids must agree line by line."""
    from ..operators.frames import numbered

    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).select(c[0].alias("_snp"), number(F.get(c, F.lit(1))).alias("value"), "_row")
    rows = numbered(rows, [F.col("_row")], "bed_idx").drop("_row")
    met = bim.join(rows, "bed_idx", "full")
    return met.where(F.assert_true(F.col("SNP").eqNullSafe(F.col("_snp")), "ids of values and BIM differ").isNull()).drop("_snp")


def _chromosome(c: Column) -> Column:
    """The number of a chromosome as PLINK writes it, without ``chr`` before it; X, Y, MT and other names are null and meet no SNP."""
    name = F.regexp_replace(c, "^(chr)+", "")
    return F.when(name.rlike("^(0|[1-9][0-9]{0,2})$"), name.try_cast("int"))


def _whole(c: Column, what: str) -> Column:
    """A whole number; anything else is an error when it is read."""
    return F.coalesce(
        c.try_cast("long"), F.raise_error(F.concat(F.lit(f"{what} isn't a whole number: "), F.coalesce(c, F.lit("missing")))).cast("long")
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(CHR, s, e) of a BED region file: headers skipped, ``chr`` prefixes stripped, bad numbers are errors; CHR is null for X and the like."""
    c = F.split(F.trim("value"), "\t", -1)
    rows = lines(spark, path).where(~F.trim("value").rlike(r"^(#|track|browser)"))
    return rows.select(_chromosome(c[0]).alias("CHR"), _whole(F.get(c, F.lit(1)), "start").alias("s"), _whole(F.get(c, F.lit(2)), "end").alias("e"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where(~F.trim("value").startswith("#")).select(F.trim("value").alias("GENE")).distinct()


def read_gene_coordinates(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """GENE, CHR, START, END, of some ``genes`` if they are given; lines that begin with # and a header line are left out, other bad numbers are errors."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(~F.trim("value").startswith("#")).where(~F.coalesce(F.upper(F.get(c, F.lit(2))) == "START", F.lit(False)))
    rows = rows.select(c[0].alias("GENE"), F.get(c, F.lit(1)).alias("c"), F.get(c, F.lit(2)).alias("s"), F.get(c, F.lit(3)).alias("e"))
    if genes is not None:
        rows = rows.join(genes, "GENE", "left_semi")
    return rows.select(
        "GENE", _chromosome(F.col("c")).alias("CHR"), _whole(F.col("s"), "START").alias("START"), _whole(F.col("e"), "END").alias("END")
    )


def biobank_sumstats(df: DataFrame, population: str, p_scale: str = "neglog10") -> DataFrame:
    """Per-population columns of a biobank file as sumstats; low-confidence rows go, P is clipped to [1e-300, 1]."""
    value = number(F.col({"neglog10": f"neglog10_pval_{population}", "ln": f"pval_{population}", "raw": f"pval_{population}"}[p_scale]))
    p = {"neglog10": F.pow(F.lit(10.0), -value), "ln": F.exp(value), "raw": value}[p_scale]
    low = f"low_confidence_{population}"
    if low in df.columns:
        df = df.where(~(F.lower(low) == "true"))
    return df.select(
        F.concat_ws(":", "chr", "pos", "ref", "alt").alias("SNP"), F.col("alt").alias("A1"), F.col("ref").alias("A2"),
        number(F.col(f"beta_{population}")).alias("BETA"), number(F.col(f"se_{population}")).alias("SE"), F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)).alias("P"), "_row",
    )


def decode_table(spark: SparkSession, data: bytes) -> DataFrame:
    """A table that is in memory, as text or gzip (told by its first bytes)."""
    import gzip

    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
    rows = [x for x in text.splitlines() if x.strip()]
    names = names_of(rows[0])
    cells = [(x.split("\t") if "\t" in rows[0] else x.split()) for x in rows[1:]]
    cells = [(*[c.strip() for c in x[: len(names)]], *[None] * (len(names) - len(x)), i) for i, x in enumerate(cells)]
    return spark.createDataFrame(cells, ", ".join(f"`{n.strip()}` string" for n in names) + ", _row long")
