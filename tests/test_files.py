"""Commands over files in temporary folders."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldlake.operators import annotations, frames, ldscore, munging, windows
from ldlake.plans import commands
from ldlake.sources import plink, readers, writers


#: Rows of the study: even ranks are kept, others fail one filter each.
STUDY = 640


def study_rows():
    """(cells, kept) of a study whose every fifth row lacks something."""
    rng = np.random.default_rng(41)
    for i in range(STUDY):
        effect, allele = rng.normal(0, 0.02), ("AG", "CA", "TC", "GA")[i % 4]
        row = {
            "SNP": f"rs{7 * i + 3}", "A1": allele[0].lower(), "A2": allele[1], "BETA": f"{effect:.5f}", "P": f"{rng.uniform(0.001, 1):.4f}",
            "N": str(5000 + i % 4), "INFO": "0.97", "FRQ": f"{rng.uniform(0.1, 0.9):.3f}", "NOTE": "ok"
        }
        fault = i % 5 == 4
        if fault:
            row |= ({"INFO": "0.2"}, {"FRQ": "0.003"}, {"A2": allele[0]}, {"NOTE": "NA"}, {"P": "1.5"}, {"BETA": "."}, {"N": "20"})[i // 5 % 7]
        yield row, not fault


@pytest.fixture()
def sumstats(tmp_path):
    rows = [r for r, _ in study_rows()]
    path = tmp_path / "study.txt"
    path.write_text("\t".join(rows[0]) + "\n" + "".join("\t".join(r.values()) + "\n" for r in rows))
    return str(path)


def test_munge_and_h2(spark, sumstats, tmp_path):
    done = commands.run_munge(spark, sumstats, str(tmp_path / "out"))
    kept = [r["SNP"] for r, ok in study_rows() if ok]
    assert done.count() == len(kept)
    again = readers.read_table(spark, str(tmp_path / "out.sumstats.gz"))
    assert again.columns == ["SNP", "A1", "A2", "Z", "N", "_row"] and [r["SNP"] for r in again.orderBy("_row").collect()] == kept
    assert gzip.open(tmp_path / "out.sumstats.gz", "rt").readline() == "SNP\tA1\tA2\tZ\tN\n"
    counts = commands.munge_counts(spark, sumstats)
    assert counts[0] == ("read", STUDY) and sum(n for _, n in counts[1:]) == STUDY - len(kept) and dict(counts)["alleles"] > 0 and dict(counts)["missing values"] > 0
    with gzip.open(tmp_path / "ref.gz", "wt") as f:
        f.write("CHR SNP BP L2\n" + "".join(f"1 {s} {i} {1 + i % 50}\n" for i, s in enumerate(kept)))
    with pytest.warns(UserWarning, match="200k"):
        h, text = commands.run_h2(
            spark, str(tmp_path / "out.sumstats.gz"), str(tmp_path / "ref.gz"), str(tmp_path / "ref.gz"),
            opts=commands.RegressionOptions(samp_prev=0.5, pop_prev=0.01)
        )
    assert text.startswith("Total Observed scale h2:") and "Liability" in text and np.isfinite(h.h2)
    pairs, text = commands.run_rg(spark, [str(tmp_path / "out.sumstats.gz")] * 2, str(tmp_path / "ref.gz"), str(tmp_path / "ref.gz"))
    assert len(pairs) == 1 and "Genetic Correlation" in text
    with pytest.raises(ValueError, match="no SNPs"):
        (tmp_path / "none.txt").write_text("SNP\tZ\tN\nzz\t1\t2\n")
        commands.run_h2(spark, str(tmp_path / "none.txt"), str(tmp_path / "ref.gz"), str(tmp_path / "ref.gz"))


def test_rows_are_numbered_by_file_order_at_every_size(spark, tmp_path):
    for c in (1, 2):
        (tmp_path / f"n{c}.txt").write_text("x\n" + "".join(f"{c}-{i}\n" for i in range(500)))
    df = readers.read_table(spark, [str(tmp_path / "n2.txt"), str(tmp_path / "n1.txt")])
    want = [f"{c}-{i}" for c in (2, 1) for i in range(500)]
    for parts in (1, 10):
        got = frames.numbered(df, [F.col("_row")], "_i", total="n", parts=parts).collect()
        assert [
            r["x"] for r in sorted(got, key=lambda r: r["_i"])
        ] == want and sorted(r["_i"] for r in got) == list(range(1000)) and {r["n"] for r in got} == {1000}
    odd = spark.createDataFrame([(None, 1), ("b", 2), ("b", 3), ("a", 4)], "k string, v int")
    assert [r["v"] for r in sorted(frames.numbered(odd, [F.col("k"), F.col("v").desc()]).collect(), key=lambda r: r["_i"])] == [1, 4, 3, 2]
    assert frames.numbered(odd.limit(0), [F.col("k")]).count() == 0


def test_table_rules(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x  y   z\n1 NA\n\n 2 .  3 \nx y z\nnan na q\n")
    df = readers.read_table(spark, str(tmp_path / "a.txt"))
    assert [tuple(r) for r in df.orderBy("_row").select("x", "y", "z").collect()] == [
        ("1", None, None), ("2", None, "3"), ("x", "y", "z"), (None, None, "q")
    ]
    assert dict(readers.typed(df.where("x in ('1', '2')")).dtypes)["x"] == "double"
    with pytest.raises(ValueError):
        frames.rename(df, {"x": "y"})
    with pytest.raises(ValueError):
        frames.select(df, ["q"])
    with pytest.raises(ValueError):
        frames.stacked([df, df.drop("x")])
    one, two = (spark.createDataFrame([(i, i) for i in range(3)], f"_row long, {c} long") for c in "ab")
    assert frames.side_by_side(one, two).columns == ["_row", "a", "b"]
    (tmp_path / "b.txt").write_text("x y w\n1 2 3\n")
    with pytest.raises(ValueError, match="other columns"):
        readers.read_table(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])


def test_tables_of_the_same_keys_are_put_side_by_side(spark):
    left = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2), (None, 4, 3)], "SNP string, x int, _row int")
    right = spark.createDataFrame([("a", 10, 0), ("b", 20, 1), ("a", 30, 2), (None, 40, 3)], "SNP string, y int, at int")
    merged = lambda r: sorted((x["x"], x["y"]) for x in frames.merge_aligned(left, r, "SNP", [F.col("_row")], [F.col("at")]).collect())
    assert merged(right) == [(1, 10), (2, 20), (3, 30), (4, 40)]
    assert merged(right.where("y < 40")) == merged(right.where("y < 30")) == [(1, 10), (2, 20), (3, 10)]
    assert merged(right.withColumn("at", 3 - F.col("at"))) == [(1, 30), (2, 20), (3, 30)]


def test_files_of_one_name_and_of_many_members(spark, tmp_path):
    for c in (3, 1, 2):
        (tmp_path / f"chr {c}+%41").mkdir()
        (tmp_path / f"chr {c}+%41" / "ld.l2.ldscore").write_text("CHR SNP\n" + "".join(f"{c} rs{c}{i}\n" for i in range(3)))
    got = readers.read_split(spark, str(tmp_path / "chr @+%41/ld"), ".l2.ldscore").orderBy("_row").collect()
    assert [r["SNP"] for r in got] == [f"rs{c}{i}" for c in (1, 2, 3) for i in range(3)]
    text = "SNP Z\n" + "".join(f"rs{i} {i}\n" for i in range(200))
    (tmp_path / "x.txt.bgz").write_bytes(b"".join(gzip.compress(text[a : a + 400].encode()) for a in range(0, len(text), 400)))
    got = readers.read_table(spark, str(tmp_path / "x.txt.bgz"))
    assert got.columns == ["SNP", "Z", "_row"] and [r["Z"] for r in got.orderBy("_row").collect()] == [str(i) for i in range(200)]
    writers.write_table(got, str(tmp_path / "y.txt.gz"), [F.col("_row")])
    assert gzip.open(tmp_path / "y.txt.gz", "rt").read() == text.replace(" ", "\t") and readers.read_table(spark, str(tmp_path / "y.txt.gz")).count() == 200


def test_gzip_tables_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    from ldlake.sources import members

    monkeypatch.setattr(members, "RANGE", 600)
    monkeypatch.setattr(writers, "MEMBER_ROWS", 40)
    at = str(tmp_path / "x.txt.gz")
    df = spark.range(1000).select(F.concat(F.lit("rs"), F.xxhash64("id")).alias("SNP"), (F.col("id") / 8).alias("x"), F.col("id").alias("k"))
    writers.write_table(df, at, [F.col("k")])
    want = [(r["SNP"], float(r["x"]), r["k"]) for r in df.orderBy("k").collect()]
    text = gzip.open(at, "rt").read().splitlines()  # any tool reads it
    assert text[0] == "SNP\tx\tk" and [x.split("\t")[0] for x in text[1:]] == [x[0] for x in want]
    got = readers.read_table(spark, at)
    assert got.rdd.getNumPartitions() > 8  # was one task
    rows = frames.numbered(readers.typed(got), [F.col("_row")], "i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1000)) and [r["k"] for r in rows] == [x[2] for x in want] and [r["SNP"] for r in rows] == [x[0] for x in want]
    assert all(abs(r["x"] - x[1]) < 0.001 for r, x in zip(rows, want))
    # one member of another tool: a stream, whose lines are dealt out; both kinds in one table keep their order
    other = str(tmp_path / "y.txt.gz")
    with gzip.open(other, "wt") as f:
        f.write("SNP\tx\tk\n" + "".join(f"o{i}\t{i}\t{i}\n\n" for i in range(500)))
    both = readers.read_table(spark, [other, at])
    assert "hashpartitioning(_row" in readers.read_table(spark, other)._jdf.queryExecution().toString()
    assert [r["SNP"] for r in both.orderBy("_row").collect()] == [f"o{i}" for i in range(500)] + [x[0] for x in want]


def test_sorted_rows_are_kept_by_columns(spark, monkeypatch):
    from ldlake.plans.views import Views

    df = Views(spark, "/root/testdata/sf0.001").sumstats
    scan = df.select("SNP", "_row")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<SNP:string,_m:bigint>" in scan  # was all columns of the view, and those of the order
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert frames.ranges_of(table) == 4
    monkeypatch.setattr(frames, "RANGE_BYTES", 1 << 12)
    assert frames.in_ranges(table, [F.struct("l_orderkey", "l_linenumber")]).rdd.getNumPartitions() > 8  # was 4 at every size
    same = frames.numbered(table.select("l_orderkey", F.lit(None).alias("none"), F.col("l_orderkey").alias("L_OrderKey")), [F.col("none")], "i")
    assert same.count() == table.count() and same.select("i").distinct().count() == same.count()


def test_large_tables_are_written_in_ranges(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(frames, "RANGE_BYTES", 1 << 12)
    join = writers._join_parts
    monkeypatch.setattr(writers, "_join_parts", lambda spark, parts, head, path: (seen.append(len(parts)), join(spark, parts, head, path)))
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_tax")
    order = ["l_orderkey", "l_linenumber", "l_tax"]
    writers.write_table(table, str(tmp_path / "x.gz"), [F.struct(*order)])
    assert seen[0] > 8  # was one for each shuffle partition at most, at every size
    want = [f"{r[0]}\t{r[1]}" for r in table.orderBy(*order).collect()]
    assert [x.rsplit("\t", 1)[0] for x in gzip.open(tmp_path / "x.gz", "rt").read().splitlines()[1:]] == want


def test_first_rows_are_carried_once(spark):
    """The first of equal rows of an order is the least of the rest, so it doesn't depend on how rows lie."""
    rows = [("a", 2, 1.0, "x"), ("a", 1, 2.0, "z"), ("a", 1, 2.0, "y"), (None, 5, None, "n"), (None, 4, None, None), ("b", None, 1.0, "q"), ("b", 0, 1.0, "r")]
    df = spark.createDataFrame(rows, "k string, at int, x double, t string")
    want = [(None, 4, None, None), ("a", 1, 2.0, "y"), ("b", None, 1.0, "q")]
    for order in ([F.col("at")], [F.struct("at")], [F.col("at").cast("long")]):
        got = frames.first_of(df, ["k"], order)
        assert got.dtypes == df.dtypes and {tuple(r)[:3] for r in got.collect()} == {r[:3] for r in want}
    plan = frames.first_of(df, ["k"], [F.col("at")])
    assert set(map(tuple, plan.collect())) == set(want) and "min_by" not in plan._jdf.queryExecution().toString()
    assert set(map(tuple, frames.first_of(df, ["k"], [F.col("k"), F.col("at")]).collect())) == set(want)
    assert frames.first_of(df.withColumn("m", F.create_map("k", "t")).where("k IS NOT NULL"), ["k"], [F.col("at")]).count() == 2


def test_lines_of_members(monkeypatch):
    import io

    from ldlake.sources import members

    monkeypatch.setattr(members, "_BLOCK", 7)
    text = [f"{'long ' * (i % 40)}{i}\n" for i in range(300)] + ["no end"]
    packed = b"".join(gzip.compress("".join(text[a : a + 50]).encode()) for a in range(0, 301, 50))
    assert b"".join(members._blocks(io.BytesIO(packed), 0, len(packed))).decode() == "".join(text)
    assert all(x.endswith(b"\n") for x in list(members._blocks(io.BytesIO(packed), 0, len(packed)))[:-1])
    with pytest.raises(EOFError):
        list(members._blocks(io.BytesIO(packed[:-9]), 0, len(packed)))
    plain = gzip.compress(b"x", mtime=0)
    named = members.header(plain[: members.PLAIN], len(plain)) + plain[members.PLAIN :]
    assert gzip.decompress(named) == b"x" and members.length(named[: members.LONG]) == len(named) and members.length(plain[: members.LONG]) is None


def test_files_of_every_chromosome(spark, tmp_path):
    for c in (2, 10, 22, 23, 31):
        (tmp_path / f"x{c}.l2.ldscore").write_text(f"CHR SNP\n{c} rs{c}\n")
        (tmp_path / f"chr {c}").mkdir()
        (tmp_path / f"chr {c}" / f"y{c}.ld").write_text(f"CHR SNP\n{c} rs{c}\n")
    (tmp_path / "x.l2.ldscore").write_text("CHR SNP\n99 all\n")
    (tmp_path / "x07.l2.ldscore").write_text("CHR SNP\n7 no\n")
    for prefix, suffix in (("x", ".l2.ldscore"), ("x@", ".l2.ldscore"), ("chr @/y@", ".ld")):
        at = str(tmp_path / prefix)
        assert [r["CHR"] for r in readers.read_split(spark, at, suffix).orderBy("_row").collect()] == ["2", "10", "22"]
        assert [r["CHR"] for r in readers.read_split(spark, at, suffix, every=True).orderBy("_row").collect()] == ["2", "10", "22", "23", "31"]
    assert readers.present(spark, str(tmp_path / "none" / "x"), ".ld", True) == []


def test_query_of_many_chromosomes(spark, tmp_path):
    """The table has SNPs on chromosomes above 22."""
    import duckdb

    from ldlake.plans import file_queries, registry  # noqa: F401

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 250")
    rows.withColumn("vec_id", F.col("vec_id") + 2700).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.ORACLE["l2_files"]).df()
    got = registry.QUERIES["l2_files"](spark, str(tmp_path)).toPandas()
    assert want["CHR"].max() > 22 and len(want) == 250
    assert set(got.itertuples(index=False, name=None)) == set(want[list(got.columns)].itertuples(index=False, name=None))


def test_number_format(spark):
    from ldlake.functions.columns import float_text

    odd = [0.0, -0.0, -0.0004, 0.0005, 1.0005, 0.9996, 1e15, -1e20, float("inf"), 99999999999999.5, 1200.0]
    want = ["0.0", "-0.0", "-0.0", "0.001", "1.001", "1.0", "1000000000000000.0", "-100000000000000000000.0", "Infinity", "99999999999999.5", "1200.0"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in odd], "x double").select(float_text(F.col("x"))).collect()] == want
    df = spark.createDataFrame([(6702.0,), (0.123456,), (-0.029,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(float_text(F.col("x"))).collect()] == ["6702.0", "0.123", "-0.029", "", ""]


def test_daner_and_names(spark):
    row = spark.createDataFrame(
        [(1, "rs1", "A", "C", 0.1, 0.2, 1.1, 0.01, 5.0, 7.0)],
        "_row long, snp string, a1 string, a2 string, FRQ_A_50 double, FRQ_U_70 double, `or` double, p double, Nca double, Nco double"
    )
    got = munging.munge(row, munging.MungeOptions(daner=True, keep_maf=True)).first()
    assert (got["N"], got["FRQ"]) == (120.0, 0.2)
    assert munging.munge(row, munging.MungeOptions(daner_n=True)).first()["N"] == 12.0
    with pytest.raises(ValueError):
        munging.MungeOptions(daner=True, daner_n=True)
    odd = spark.createDataFrame([(1, "rs1", 2.0, 100.0)], "_row long, MARKERNAME string, ZSCORE double, WEIGHT double")
    assert munging.munge(odd, munging.MungeOptions(no_alleles=True)).first()[:3] == ("rs1", 2.0, 100.0)


def write_fileset(tmp_path, g):
    snps, people = g.shape
    (tmp_path / "x.bed").write_bytes(plink.MAGIC + plink.encode_block(g))
    (tmp_path / "x.bim").write_text("".join(f"{1 + i // 30}\trs{i}\t{i / 100}\t{1000 * (i + 1)}\tA\tC\n" for i in range(snps)))
    (tmp_path / "x.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(people)))
    return str(tmp_path / "x")


def literal_scores(g, chromosome, left):
    """Pairs one by one."""
    x = []
    for row in g:
        seen = row >= 0
        mean = row[seen].mean()
        var = (row[seen] ** 2).sum() / row.size - seen.sum() * mean**2 / row.size
        x.append(np.where(seen, (row - mean) / var**0.5, 0) if var > 1e-12 else np.zeros(row.size))
    n, m = g.shape[1], g.shape[0]
    out = np.ones(m)
    for j in range(m):
        for i in range(j):
            if chromosome[i] == chromosome[j] and i >= left[j]:
                r = x[i] @ x[j] / n
                out[[i, j]] += r * r - (1 - r * r) / (n - 2)
    return out


def test_ld_scores(spark, tmp_path):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 3, (60, 23)).astype(np.int8)
    g[rng.random(g.shape) < 0.05] = -1
    g[7] = 1
    path = write_fileset(tmp_path, g)
    bed = plink.read_bed(spark, f"{path}.bed", 23, 60, per=16).orderBy("bed_idx").collect()
    assert [[-1 if v is None else v for v in r["g"]] for r in bed] == g.tolist()
    chromosome = np.arange(60) // 30
    got = commands.run_l2(spark, path, str(tmp_path / "ld"), commands.LdOptions(snps=5, snp_level_masking=True))
    l2 = [r["L2"] for r in got["scores"].orderBy("bed_idx").collect()]
    left = np.maximum(np.arange(60) - 5, chromosome * 30)
    assert np.allclose(l2, literal_scores(g, chromosome, left))
    got = commands.run_l2(spark, path, None, commands.LdOptions(snps=5, chunk=4))
    at = np.arange(60) % 30
    start = at // 4 * 4
    left = np.maximum(start - 5, 0) // 4 * 4 + chromosome * 30
    assert np.allclose([r["L2"] for r in got["scores"].orderBy("bed_idx").collect()], literal_scores(g, chromosome, left))
    assert readers.read_table(spark, str(tmp_path / "ld.l2.ldscore.gz")).count() == 60
    single = commands.run_l2(spark, path, None, commands.LdOptions(snps=5, snp_level_masking=True, fast_f32=True))
    assert np.allclose([r["L2"] for r in single["scores"].orderBy("bed_idx").collect()], l2, atol=1e-5)
    for opts in (
        commands.LdOptions(kb=5, per_allele=True), commands.LdOptions(cm=0.1, maf=0.05, sketch=10),
        commands.LdOptions(snps=5, global_pass=True)
    ):
        assert commands.run_l2(spark, path, None, opts)["scores"].count() > 0
    (tmp_path / "keep.txt").write_text("# some\n" + "".join(f"f{i} i{i}\n" for i in range(0, 23, 2)))
    got = commands.run_l2(spark, path, None, commands.LdOptions(snps=5, snp_level_masking=True, keep=str(tmp_path / "keep.txt")))
    left = np.maximum(np.arange(60) - 5, chromosome * 30)
    assert np.allclose([r["L2"] for r in got["scores"].orderBy("bed_idx").collect()], literal_scores(g[:, ::2], chromosome, left))
    with pytest.raises(ValueError):
        commands.LdOptions(kb=1, cm=1)
    with pytest.raises(ValueError):
        commands.LdOptions(cts_bin="x", cts_breaks="1", extract="y")
    text = writers.ld_summary(got["summary"].collect(), got["correlations"].collect(), got["columns"], "ld.l2.ldscore.gz")
    lines = text.splitlines()
    assert lines[1] == "Summary of LD Scores in ld.l2.ldscore.gz" and lines[2].split() == ["MAF", "L2"] and [x.split()[0] for x in lines[3:10]] == [
        "mean", "std", "min", "25%", "50%", "75%", "max"
    ]
    assert lines[11] == "MAF/LD Score Correlation Matrix" and lines[13].split()[1] == "1.0000"


def test_people_are_decoded_block_by_block(monkeypatch):
    rng = np.random.default_rng(6)
    g = rng.integers(-1, 3, (9, 45)).astype(np.int8)
    width = -(-45 // 4)
    raw = plink.encode_block(g)
    rows = [raw[i * width : (i + 1) * width] for i in range(9)]
    monkeypatch.setattr(ldscore, "PEOPLE", 8)
    for keep in (None, (3, 44, 0, 17, 18, 40, 2, 1, 30, 31, -2)):
        packed = ldscore.Packed(45, keep)
        want = g if keep is None else g[:, list(keep)]
        assert (np.hstack([x for _, x in packed.blocks(rows)]) == want).all()
        seen = (want >= 0).sum(1)
        _, n, mean, var = ldscore.moments(rows, packed)
        assert (n == seen).all() and np.allclose(mean, np.where(want >= 0, want, 0).sum(1) / np.maximum(seen, 1))


def test_runs_of_chromosomes_and_annotations_by_chromosome(spark, tmp_path):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (30, 16)).astype(np.int8)
    path = write_fileset(tmp_path, g)
    chromosome = [1] * 10 + [2] * 10 + [1] * 10
    (tmp_path / "x.bim").write_text("".join(f"{c}\trs{i}\t0\t{1000 * (i + 1)}\tA\tC\n" for i, c in enumerate(chromosome)))
    got = commands.run_l2(spark, path, None, commands.LdOptions(snps=4, snp_level_masking=True))
    run = np.repeat([0, 10, 20], 10)
    assert np.allclose([r["L2"] for r in got["scores"].orderBy("bed_idx").collect()], literal_scores(g, run, np.maximum(np.arange(30) - 4, run)))
    (tmp_path / "x.bim").write_text("".join(f"{1 + i // 15}\trs{i}\t0\t{1000 * (i + 1)}\tA\tC\n" for i in range(30)))
    for c in (1, 2):
        (tmp_path / f"an.{c}.annot").write_text("CHR BP SNP CM all odd\n" + "".join(f"{c} 0 rs{i} 0 1 {i % 2}\n" for i in range(15 * c - 15, 15 * c)))
    whole = commands.run_l2(spark, path, None, commands.LdOptions(snps=4, annot=str(tmp_path / "an.")))
    assert whole["m"].first()["odd_M"] == 15 and "oddL2" in whole["scores"].columns
    (tmp_path / "an.2.annot").write_text("CHR BP SNP CM all odd\n2 0 rs15 0 1 1\n")
    with pytest.raises(ValueError, match="16 rows for 30 SNPs"):
        commands.run_l2(spark, path, None, commands.LdOptions(snps=4, annot=str(tmp_path / "an.")))
    (tmp_path / "no.txt").write_text("zz\n")
    with pytest.raises(ValueError, match="print-snps"):
        commands.run_l2(spark, path, None, commands.LdOptions(snps=4, print_snps=str(tmp_path / "no.txt")))


def test_regions_of_odd_chromosomes_and_numbers(spark, tmp_path):
    (tmp_path / "r.bed").write_text("track a\nchrX\t1\t5\nchr2\t10\t20\nMT\t1\t2\nchr07\t1\t2\n")
    assert [
        tuple(r) for r in readers.read_regions(spark, str(tmp_path / "r.bed")).orderBy("s", "e").collect()
    ] == [(None, 1, 2), (None, 1, 2), (None, 1, 5), (2, 10, 20)]
    (tmp_path / "bad.bed").write_text("chr1\tx\t5\n")
    with pytest.raises(Exception, match="start isn't a whole number"):
        readers.read_regions(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "c.txt").write_text("GENE CHR START END\n# note\nG1 chr1 5 9\nG2 1 bad 9\n")
    (tmp_path / "g.txt").write_text("# note\nG1\n")
    genes = readers.read_genes(spark, str(tmp_path / "g.txt"))
    assert [tuple(r) for r in readers.read_gene_coordinates(spark, str(tmp_path / "c.txt"), genes).collect()] == [("G1", 1, 5, 9)]
    with pytest.raises(Exception, match="START isn't a whole number"):
        readers.read_gene_coordinates(spark, str(tmp_path / "c.txt")).collect()
    assert annotations.edges([1234567.25, 0.1], 0, 2e6)[1] == ["min_0.1", "0.1_1234567.25", "1234567.25_max"]


def test_two_equal_snps(spark):
    df = plink.from_bytes(spark, plink.MAGIC + b"\xf0\xf0", 4, 2).withColumns({"CHR": F.lit(1), "pos": F.col("bed_idx"), "BP": F.col("bed_idx") * 10})
    df = windows.effective_left(windows.block_left_kb(ldscore.standardised(df), 100), 2).withColumn("a", F.array(F.lit(1.0)))
    assert [r["l2"][0] for r in ldscore.scores(df, 4).orderBy("pos").collect()] == [2.0, 2.0]
    assert [r[0] for r in df.select("maf").collect()] == [0.5, 0.5]
    for bad in (b"\0\0\1\xf0", b"\x6c\x1b\0\xf0", plink.MAGIC + b"\xf0\xf0\xf0"):
        with pytest.raises(ValueError):
            plink.from_bytes(spark, bad, 4, 1)


def test_annotations(spark, tmp_path):
    write_fileset(tmp_path, np.ones((60, 4), np.int8))
    (tmp_path / "r.bed").write_text("track x\nchr1\t999\t3000\nchr1\t2500\t4000\nchr2\t0\t31000\n")
    got = commands.run_make_annot(spark, str(tmp_path / "x.bim"), str(tmp_path / "out.annot"), bed=str(tmp_path / "r.bed"))
    assert got.columns[-1] == "r" and [r["SNP"] for r in got.where("r = 1").collect()] == ["rs0", "rs1", "rs2", "rs3", "rs30"]
    (tmp_path / "g.txt").write_text("G1\n")
    (tmp_path / "c.txt").write_text("GENE CHR START END\nG1 1 1500 2500\nG2 1 9000 9900\n")
    got = commands.run_make_annot(
        spark, str(tmp_path / "x.bim"), None, gene_set=str(tmp_path / "g.txt"), gene_coords=str(tmp_path / "c.txt"), windowsize=600
    )
    assert got.where("g = 1").count() == 3
    (tmp_path / "v.txt").write_text("".join(f"rs{i} {i / 60}\n" for i in range(60)))
    hot = commands.run_cts_annot(spark, str(tmp_path / "x.bim"), [str(tmp_path / "v.txt")], "0.25,0.5", None, ["V"])
    assert hot.columns[4:] == ["V_min_0.25", "V_0.25_0.5", "V_0.5_max"]
    assert hot.where("`V_min_0.25` + `V_0.25_0.5` + `V_0.5_max` = 1").count() == 60
    assert annotations.parse_breaks("N1,2x3") == [[-1.0, 2.0], [3.0]]
    with pytest.raises(ValueError):
        annotations.edges([5.0], 0, 1)


def test_sidecars(spark, tmp_path):
    for c in (1, 2):
        (tmp_path / f"p.{c}.l2.M_5_50").write_text("10\t20\n")
    assert readers.m_vector(spark, [str(tmp_path / "p.")], True) == [20.0, 40.0]
    assert readers.m_total(spark, str(tmp_path / "p.@")) == 20.0
    assert readers.chromosome_path("a@b", 3) == "a3b" and readers.paths(" a, ,b") == ["a", "b"]
    (tmp_path / "s.txt").write_text("rs1\n# no\nrs2 x\n")
    assert readers.read_snp_list(spark, str(tmp_path / "s.txt")).count() == 2
    with pytest.raises(Exception):
        readers.read_snp_list(spark, str(tmp_path / "s.txt"), True).count()
    (tmp_path / "k.ldcts").write_text("liver a.,b.\n")
    assert readers.read_ldcts(spark, str(tmp_path / "k.ldcts")) == [("liver", ["a.", "b."])]
    (tmp_path / "f.frq").write_text("SNP MAF\nrs1 0.04\nrs2 NA\nrs3 0.2\n")
    (tmp_path / "p.2.l2.M_5_50").write_text("10\n")
    with pytest.raises(ValueError, match="differ in length"):
        readers.m_vector(spark, [str(tmp_path / "p.")], True)
    with pytest.raises(ValueError, match="differ in length"):
        commands._m(spark, str(tmp_path / "p."), True, commands.RegressionOptions(), 9, 1)
    assert [r["common"] for r in readers.read_frequencies(spark, str(tmp_path / "f.frq")).orderBy("_row").collect()] == [False, False, True]


def test_result_tables():
    rows = [{"name": "b", "coefficient": 1.0, "coefficient_se": 0.5, "p": 0.2}, {"name": "a", "coefficient": 2.0, "coefficient_se": 0.5, "p": 0.1}]
    assert writers.cell_type_table(rows).splitlines()[1].startswith("a\t2.000000e+00")


def test_in_memory(spark):
    from ldlake.plans import memory

    rng = np.random.default_rng(9)
    g = rng.integers(0, 3, (300, 40)).astype(np.int8)
    bim = "".join(f"{1 + i // 200}\trs{i}\t0\t{1000 * i}\tA\tC\n" for i in range(300))
    told = []
    got = memory.l2_from_bytes(
        spark, plink.MAGIC + plink.encode_block(g), bim, 40, snps=5, chunk=None, progress=lambda done, all_: told.append((done, all_))
    )
    assert told == [(200, 300), (300, 300)]
    assert got.count() == 300
    left = np.maximum(np.arange(300) - 5, (np.arange(300) // 200) * 200)
    assert np.allclose([r["L2"] for r in got.orderBy("bed_idx").collect()], literal_scores(g, np.arange(300) // 200, left))
    text = "SNP\tZ\tN\n" + "".join(f"rs{i}\t{rng.normal():.4f}\t1000\n" for i in range(300))
    for data in (text.encode(), gzip.compress(text.encode())):
        assert np.isfinite(memory.h2_from_bytes(spark, data, got, 20).h2)
    with pytest.raises(ValueError):
        memory.h2_from_bytes(spark, b"SNP\tZ\tN\nrs1\t1\t1\n", got)
    assert memory.balanced({1: 10, 2: 7, 3: 5, 4: 1}, 2) == [[1, 4], [2, 3]]
    table = memory.bim_table(spark, "1\ta\t0\t1\tA\tC\n1\tb\tx\t2\tA\tC\n2\tc\t0\ty\tA\tC\n1\td\t0\t4\tA\tC\n")
    assert [r["run"] for r in windows.chromosome_runs(table).orderBy("bed_idx").collect()] == [0, 0, 2, 3]
    places = spark.createDataFrame([(1, 0), (0, 1), (1, 2)], "at long, _to long")
    assert [r["SNP"] for r in frames.take_rows(table.withColumnRenamed("bed_idx", "_row"), places).orderBy("_row").collect()] == ["b", "a", "b"]


def test_sketch_is_near_exact(spark):
    from ldlake.operators import sketch

    rng = np.random.default_rng(11)
    base = rng.integers(0, 3, (1, 400))
    g = np.where(rng.random((60, 400)) < np.linspace(0.05, 0.9, 60)[:, None], rng.integers(0, 3, (60, 400)), base)
    df = spark.createDataFrame([(1, i, i * 10, [int(x) for x in row]) for i, row in enumerate(g)], "CHR int, pos long, BP long, g array<int>")
    x = windows.effective_left(windows.block_left_kb(ldscore.standardised(df), 10), None).withColumn("a", F.array(F.lit(1.0)))
    exact = np.array([r["l2"][0] for r in ldscore.scores(x, 400).orderBy("pos").collect()])
    rough = np.array([r["l2"][0] for r in ldscore.scores(sketch.project(x, 400, 200), 400, sketch=200).orderBy("pos").collect()])
    assert np.corrcoef(exact, rough)[0, 1] > 0.9
    with pytest.raises(ValueError):
        sketch.check_dimensions(400, 400)


def test_result_files(spark, tmp_path):
    rng = np.random.default_rng(13)
    n, ld = 400, {}
    for name in ("base.", "w.", "a.", "b."):
        ld[name] = 1 + rng.random((2, n)) * 20 if name == "base." else 1 + rng.random((1, n)) * 9
        columns = ["oneL2", "twoL2"] if name == "base." else ["L2"]
        for c in (1, 2):
            at = range((c - 1) * n // 2, c * n // 2)
            (tmp_path / f"{name}{c}.l2.ldscore").write_text(
                "\t".join(["CHR", "SNP", "BP", *columns]) + "\n" + "".join(
                    "\t".join([str(c), f"rs{i}", str(i), *(f"{x[i]:.3f}" for x in ld[name])]) + "\n" for i in at
                )
            )
            (tmp_path / f"{name}{c}.l2.M_5_50").write_text("\t".join(["500"] * len(columns)) + "\n")
            if name == "base.":
                (tmp_path / f"base.{c}.annot").write_text("CHR\tBP\tSNP\tCM\tone\ttwo\n" + "".join(f"{c}\t{i}\trs{i}\t0\t1\t{i % 2}\n" for i in at))
    for name in "xy":
        z = rng.normal(size=n) * np.sqrt(1 + ld["base."].sum(0) / 10)
        (tmp_path / f"{name}.txt").write_text("SNP\tA1\tA2\tZ\tN\n" + "".join(f"rs{i}\tA\tC\t{v:.4f}\t1000\n" for i, v in enumerate(z)))
    at, out = (lambda x: str(tmp_path / x)), str(tmp_path / "o")
    options = commands.RegressionOptions(n_blocks=20, overlap_annot=True)
    (fit, rows), text = commands.run_h2(spark, at("x.txt"), at("base."), at("w."), out, options, True)
    lines = (tmp_path / "o.results").read_text()
    assert lines == writers.overlap_table(rows) and len(lines.splitlines()) == 3 and text.endswith(lines) and text.startswith("Total observed-scale h2")
    fit, text = commands.run_h2(
        spark, at("x.txt"), at("base."), at("w."), None, commands.RegressionOptions(n_blocks=20, print_coefficients=True), True
    )
    cells = [line.split() for line in text.splitlines()]
    assert ["Category", "Prop_h2", "Prop_SNPs", "Enrichment", "Coefficient"] in cells
    assert ["twoL2", f"{fit.prop[1]:.4f}", "0.5000", f"{2 * fit.prop[1]:.4f}", f"{fit.coef[1]:.4e}"] in cells
    (tmp_path / "k.ldcts").write_text(f"liver {at('a.')},{at('b.')}\nbrain {at('b.')}\n")
    for every, names in ((False, ["brain", "liver"]), (True, ["brain", "liver", "liver_1"])):
        rows, text = commands.run_cell_types(
            spark, at("x.txt"), at("base."), at("w."), at("k.ldcts"), commands.RegressionOptions(n_blocks=20, print_all_cts=every), out
        )
        assert (tmp_path / "o.cell_type_results.txt").read_text() == text and sorted(line.split()[0] for line in text.splitlines()[1:]) == names
        assert [r["p"] for r in rows] == sorted(r["p"] for r in rows)
    (found,), text = commands.run_rg(spark, [at("x.txt"), at("y.txt")], at("w."), at("w."), commands.RegressionOptions(n_blocks=20), True)
    head, row = text.split("Summary of Genetic Correlation Results\n")[1].splitlines()
    assert head.split()[:3] == ["p1", "p2", "rg"] and row.split()[:2] == [at("x.txt"), at("y.txt")]
    assert row.split()[6:] == [
        f"{v:.4f}" for v in (found.h2.h2, found.h2.se, found.h2.intercept, found.h2.intercept_se, found.gencov.intercept, found.gencov.intercept_se)
    ]


def test_ld_scores_feed_h2(spark, tmp_path):
    rng = np.random.default_rng(15)
    g = rng.integers(0, 3, (60, 23)).astype(np.int8)
    g[3:10] = np.eye(7, 23, dtype=np.int8)  # rare
    path, out = write_fileset(tmp_path, g), str(tmp_path / "ld")
    (tmp_path / "print.txt").write_text("".join(f"rs{i}\n" for i in range(30)))
    got = commands.run_l2(spark, path, out, commands.LdOptions(snps=5))
    assert [(tmp_path / f"ld{c}.l2.{m}").read_text() for c in (1, 2) for m in ("M", "M_5_50")] == ["30\n", "23\n", "30\n", "30\n"]
    again = readers.read_split(spark, out, ".l2.ldscore").orderBy("_row").collect()
    assert [r["SNP"] for r in again] == [f"rs{i}" for i in range(60)] and [r["CHR"] for r in again] == ["1"] * 30 + ["2"] * 30
    assert np.allclose([float(r["L2"]) for r in again], [r["L2"] for r in got["scores"].orderBy("bed_idx").collect()], atol=6e-4)
    (tmp_path / "s.txt").write_text("SNP\tZ\tN\n" + "".join(f"rs{i}\t{rng.normal():.4f}\t1000\n" for i in range(50)))
    h = [
        commands.run_h2(
            spark, str(tmp_path / "s.txt"), out, out, None, commands.RegressionOptions(n_blocks=10, m=m), True
        )[0].h2 for m in (None, 53.0, 50.0)
    ]
    assert h[0] == h[1] != h[2]
    commands.run_l2(spark, path, out, commands.LdOptions(snps=5, print_snps=str(tmp_path / "print.txt")))
    assert gzip.open(tmp_path / "ld2.l2.ldscore.gz", "rt").read() == "CHR\tSNP\tBP\tL2\n" and readers.read_split(spark, out, ".l2.ldscore").count() == 30
    (tmp_path / "v.txt").write_text("".join(f"rs{i} {i / 60}\n" for i in range(60)))
    for quiet in (True, False):
        commands.run_l2(
            spark, path, str(tmp_path / "cts"),
            commands.LdOptions(snps=5, cts_bin=str(tmp_path / "v.txt"), cts_breaks="0.5", cts_names="V", no_print_annot=quiet)
        )
        assert (tmp_path / "cts.annot.gz").exists() != quiet
    lines = gzip.open(tmp_path / "cts.annot.gz", "rt").read().splitlines()
    assert lines[0] == "CHR\tSNP\tBP\tCM\tV_min_0.5L2\tV_0.5_maxL2" and lines[2] == "1\trs1\t2000\t0.01\t1\t0" and lines[-1].endswith("\t0\t1") and len(lines) == 61
    assert (tmp_path / "cts2.l2.M").read_text() == "1\t29\n"
    assert not list(tmp_path.glob("*.parts*"))


@pytest.mark.parametrize("snps", [60, 10_060])
def test_whole_window_warns_at_every_size(spark, tmp_path, snps):
    g = np.random.default_rng(17).integers(0, 3, (snps, 4)).astype(np.int8)
    path = write_fileset(tmp_path, g)
    (tmp_path / "x.bim").write_text("".join(f"{1 if i < snps - 5 else 2}\trs{i}\t0\t{1000 * (i + 1)}\tA\tC\n" for i in range(snps)))
    with pytest.warns(UserWarning, match="whole chromosome"):
        got = commands.run_l2(spark, path, None, commands.LdOptions(snps=6))
    assert got["scores"].count() == snps
