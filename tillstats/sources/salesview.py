"""The sales table over a star schema of orders, as one SQL text that several engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "customer", "part")
SQL = """
SELECT o_orderdate AS FECHA,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'APP' WHEN 'BUILDING' THEN 'WEB' ELSE 'POS' END AS CANAL,
  l_partkey AS SKU, p_name AS PRODUCTO, CAST(l_quantity AS BIGINT) AS UNIDADES,
  CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN NULL ELSE l_discount END AS PORCENTAJE_DESCUENTO,
  l_extendedprice * (1 - l_discount) AS MONTO_APLICADO,
  l_orderkey AS BOLETA, l_suppkey AS LOCAL, o_custkey AS CODIGO_CLIENTE,
  CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE make_date(CAST(1945 + o_custkey % 60 AS INT),
    CAST(1 + o_custkey % 12 AS INT), CAST(1 + o_custkey % 28 AS INT)) END AS FECHA_NACIMIENTO,
  CAST(1 + o_custkey % 2 AS BIGINT) AS GENERO,
  concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS ROW_KEY
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line; ROW_KEY is unique."""
    return spark.sql(SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def sql() -> str:
    """The view's text over tables of the same names."""
    return SQL.format(**{t: t for t in TABLES})
