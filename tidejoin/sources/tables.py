"""The tables of a chain from Parquet or from pipe-delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

_MONEY = "decimal(15,2)"

# Columns of the public TPC-H tables, in file order.
TBL_SCHEMAS = {
    "region": "r_regionkey long, r_name string, r_comment string",
    "nation": "n_nationkey long, n_name string, n_regionkey long, n_comment string",
    "supplier": f"s_suppkey long, s_name string, s_address string, s_nationkey long, s_phone string, s_acctbal {_MONEY}, s_comment string",
    "part": f"p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice {_MONEY}, p_comment string",
    "partsupp": f"ps_partkey long, ps_suppkey long, ps_availqty long, ps_supplycost {_MONEY}, ps_comment string",
    "customer": f"c_custkey long, c_name string, c_address string, c_nationkey long, c_phone string, c_acctbal {_MONEY}, c_mktsegment string, c_comment string",
    "orders": f"o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice {_MONEY}, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": f"l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity {_MONEY}, l_extendedprice {_MONEY}, l_discount {_MONEY}, l_tax {_MONEY}, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table with money as DECIMAL(15,2), days as DATE and keys as long."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = c.cast(_MONEY)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and f.name.endswith("date"):
            c = c.cast("date")
        elif f.name.endswith("key") and isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def tbl_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TBL_SCHEMAS[name])


def tbl_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A pipe-delimited file whose lines end in a delimiter; no quoting; blank lines are skipped, a bad value fails.

    A missing file has no rows.
    """
    schema = T.StructType([*tbl_schema(name).fields, T.StructField("_trail", T.StringType())])
    try:
        return spark.read.schema(schema).option("sep", "|").option("quote", "").option("mode", "FAILFAST").csv(f"{path}/{name}.tbl").drop("_trail")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], tbl_schema(name))


def write_tbl(df: DataFrame, path: str, name: str) -> None:
    """A table as pipe-delimited text whose lines end in a delimiter, in as many files as Spark's tasks give.

    Columns go by the public order; those that ``df`` lacks are empty.  Texts may hold no delimiter: none is quoted.
    """
    fields = [F.coalesce(F.col(f.name).cast(f.dataType).cast("string"), F.lit("")) if f.name in df.columns else F.lit("") for f in tbl_schema(name)]
    df.select(F.concat_ws("|", *fields, F.lit("")).alias("value")).write.text(f"{path}/{name}.tbl")
