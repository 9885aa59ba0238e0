"""Views over the driver's tables that look like genetics data, for both engines.

The text of a view holds in Spark and in the oracle's engine; where lambdas differ, ``{lambda x}`` stands
for how the engine begins one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import numbered

WHOLE = "CAST(floor({a} / {b}) AS BIGINT)"  # whole division of non-negative numbers

SQL = {
    "v_sumstats": """SELECT 'rs' || CAST(l_partkey AS STRING) AS SNP,
        CASE l_linenumber % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'g' WHEN 3 THEN 'T' ELSE 'N' END AS A1,
        CASE l_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 't' END AS A2,
        round(l_discount - 0.05, 2) AS BETA, 0.01 + l_tax AS SE, (l_quantity - 1) / 40 AS P,
        CAST(200 + l_orderkey % 1500 AS DOUBLE) AS N, CAST(200 + l_orderkey % 100 AS DOUBLE) AS N_CAS, CAST(300 + l_orderkey % 200 AS DOUBLE) AS N_CON,
        1 - 2 * l_tax AS INFO, CASE WHEN l_linenumber <> 7 THEN l_discount * 9 END AS FRQ, CAST(l_linenumber AS DOUBLE) AS NSTUDY,
        l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem}""",
    "v_bim": """SELECT CAST(1 + p_size % 22 AS INT) AS CHR, 'rs' || CAST(p_partkey AS STRING) AS SNP, 1000 + p_partkey * 1500 AS BP,
        CAST(1000 + p_partkey * 1500 AS DOUBLE) / 1000000 AS CM, p_partkey AS num FROM {part}""",
    "v_ld": """SELECT 'rs' || CAST(p_partkey AS STRING) AS SNP, CAST(1 + p_size % 22 AS INT) AS CHR, 0.5 + CAST(p_partkey * 37 % 211 AS DOUBLE) / 10 AS L2,
        0.3 + CAST(p_partkey * 53 % 97 AS DOUBLE) / 8 AS w_l2, 0.25 + CAST(p_partkey * 29 % 173 AS DOUBLE) / 20 AS codingL2,
        CAST(p_partkey % 50 + 1 AS DOUBLE) / 100 AS maf, p_partkey AS num FROM {part}""",
    "v_annot": """SELECT 'rs' || CAST(p_partkey AS STRING) AS SNP, 1 AS base, CAST(p_partkey % 2 AS INT) AS coding,
        CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END AS enh, CAST(p_partkey % 100 AS DOUBLE) / 100 AS FRQ FROM {part}""",
    "v_intervals": """SELECT CAST(1 + o_custkey % 22 AS INT) AS CHR, o_orderkey * 197 AS s, o_orderkey * 197 + 200 + o_custkey % 3000 AS e FROM {orders}""",
    "v_alleles": """SELECT 'rs' || CAST(p_partkey AS STRING) AS SNP, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'T' ELSE 'G' END AS A1,
        CASE p_partkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'A' WHEN 2 THEN 'C' ELSE 'T' END AS A2 FROM {part}""",
    "v_genes": """SELECT 'G' || CAST(s_suppkey AS STRING) AS GENE, CAST(1 + s_nationkey % 22 AS INT) AS CHR, 1000 + s_suppkey * 40000 AS "START",
        1000 + s_suppkey * 40000 + 25000 AS "END", s_acctbal FROM {supplier}""",
    "v_geno": """SELECT CAST(1 + floor(vec_id / 125) AS INT) AS CHR, 'v' || CAST(vec_id AS STRING) AS SNP, 1000 + (vec_id % 125) * 7919 AS BP, vec_id % 125 AS pos,
        {transform}(embedding, {lambda x} CASE WHEN x > 0.08 THEN 2 WHEN x < -0.08 THEN 0 ELSE 1 END) AS g FROM {embeddings}""",
}
LINEITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
OTHER = {"transform": "list_transform", "lambda x": "lambda x:"}
SPARK = {"transform": "transform", "lambda x": "x ->"}


def oracle_view(name: str) -> str:
    """The view as SQL of the oracle's engine; v_sumstats and v_bim with their row numbers."""
    tables = {t: t for t in ("lineitem", "part", "orders", "supplier", "embeddings")}
    text = SQL[name].format(**tables, **OTHER)
    if name == "v_sumstats":
        return f"SELECT * EXCLUDE ({LINEITEM}), row_number() OVER (ORDER BY {LINEITEM}) - 1 AS _row FROM ({text})"
    if name == "v_bim":
        return f"SELECT *, row_number() OVER (PARTITION BY CHR ORDER BY num) - 1 AS pos FROM ({text})"
    return text


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str, **given: DataFrame) -> DataFrame:
        text = SQL[name]
        used = {t: given[t] if t in given else self.table(t) for t in ("lineitem", "part", "orders", "supplier", "embeddings") if "{" + t + "}" in text}
        for k, v in SPARK.items():
            text = text.replace("{" + k + "}", v)
        return self.spark.sql(text.replace('"', "`"), **used)

    @property
    def sumstats(self) -> DataFrame:
        return self.sumstats_of()

    def sumstats_of(self, *columns: str) -> DataFrame:
        """The sumstats (some columns of them) with row numbers; raw columns are sorted, and those of the view made of the sorted rows."""
        names = [c.strip() for c in LINEITEM.split(",")]

        def then(rows: DataFrame) -> DataFrame:
            view = self._view("v_sumstats", lineitem=rows).drop(*names)
            return view.select(*columns) if columns else view

        return numbered(self.table("lineitem").select(*names), [F.col(c) for c in names], "_row", then=then)

    @property
    def ordered(self) -> DataFrame:
        """The sumstats in the same order, ``_row`` being what the order goes by: no row numbers are made."""
        names = [c.strip() for c in LINEITEM.split(",")]
        return self._view("v_sumstats").withColumn("_row", F.struct(*names)).drop(*names)

    @property
    def bim(self) -> DataFrame:
        return numbered(self._view("v_bim"), [F.col("num")], "pos", ["CHR"])

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in SQL:
            return self._view(f"v_{name}")
        raise AttributeError(name)
