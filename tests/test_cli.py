from pathlib import Path

import pytest

from ldlake import cli
from ldlake.operators.munging import MungeOptions
from ldlake.streaming.munge_stream import row_stages


def test_implied_commands():
    assert cli.with_command(["--h2", "x"])[0] == "h2" and cli.with_command(["--rg", "a,b"])[0] == "rg"
    assert cli.with_command(["--l2", "--bfile", "x"]) == ["l2", "--bfile", "x"]
    assert cli.with_command(["l2", "--bfile", "x"])[0] == "l2"


def test_munge_and_h2_by_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "s.txt"
    raw.write_text("rsid ea nea beta pval n\n" + "".join(f"rs{i} A G {(-1) ** i * 0.1} {(i + 1) / 200} {1000 + i}\n" for i in range(150)))
    ld = tmp_path / "ld.txt"
    ld.write_text("CHR SNP BP L2\n" + "".join(f"1 rs{i} {i} {1 + i % 20}\n" for i in range(150)))
    assert cli.main(["munge-sumstats", "--sumstats", str(raw), "--out", str(tmp_path / "o")]) == 0
    assert "150 SNPs" in capsys.readouterr().out
    assert cli.main(["--h2", str(tmp_path / "o.sumstats.gz"), "--ref-ld", str(ld), "--w-ld", str(ld), "--M", "1000", "--n-blocks", "20"]) == 0
    assert "Total Observed scale h2" in capsys.readouterr().out
    assert Path(tmp_path / "o.sumstats.gz").is_file()


def test_stream(spark, tmp_path):
    rows = [("rs1", "A", "C", 0.1, 0.01, 100.0), ("rs2", "A", "T", 0.1, 0.01, 100.0), ("rs3", "A", "C", -0.1, 0.5, 10.0)]
    spark.createDataFrame(rows, "SNP string, A1 string, A2 string, BETA double, P double, N double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("SNP string, A1 string, A2 string, BETA double, P double, N double").parquet(str(tmp_path / "in"))
    q = row_stages(stream, MungeOptions(n_min=50)).writeStream.format("memory").queryName("munged").start()
    q.processAllAvailable()
    q.stop()
    assert [r["SNP"] for r in spark.sql("select * from munged").collect()] == ["rs1"]
    with pytest.raises(ValueError):
        row_stages(stream, MungeOptions())
