"""Hydrography views on the driver tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A river network on ``orders``: key k flows to k/2, a river is the odd part of k.
SEG = """
SELECT o_orderkey AS k, concat('T', o_orderkey) AS cleabs,
 concat('N', CASE WHEN o_orderstatus='F' THEN CAST(floor(o_orderkey/2) AS BIGINT) ELSE o_orderkey END) AS ini,
 concat('N', CASE WHEN o_orderstatus='F' THEN o_orderkey ELSE CAST(floor(o_orderkey/2) AS BIGINT) END) AS fin,
 CASE WHEN o_orderkey % 97 = 96 THEN 'Double sens' WHEN o_orderstatus='F' THEN 'Sens inverse' ELSE 'Sens direct' END AS sens,
 CAST(1 + o_orderkey % 5 AS INT) AS ord,
 CASE WHEN o_orderkey = 0 OR o_orderkey % 11 = 0 THEN NULL
      ELSE concat('CDE_', CAST(o_orderkey / (o_orderkey & (-o_orderkey)) AS BIGINT)) END AS river_key,
 CASE WHEN o_orderkey = 0 OR o_orderkey % 11 = 0 OR CAST(o_orderkey / (o_orderkey & (-o_orderkey)) AS BIGINT) % 7 = 0 THEN NULL
      ELSE concat('River ', CAST(o_orderkey / (o_orderkey & (-o_orderkey)) AS BIGINT)) END AS toponyme,
 (o_orderpriority='5-LOW' AND o_orderkey % 3 = 0) AS fictif,
 CAST(o_totalprice AS DECIMAL(18,2)) AS length_m
FROM orders
"""
#: The same with a shorter copy beside every fiftieth segment, and blanks among the texts.
SEG_PARALLEL = f"""
SELECT * FROM ({SEG}) UNION ALL
SELECT k, concat('P', k) AS cleabs, ini, fin, sens, ord, river_key, toponyme, fictif, CAST(length_m / 2 AS DECIMAL(18,2)) AS length_m
FROM ({SEG}) WHERE k % 50 = 0
"""
#: Two-point lines of those segments.
LINE = """
SELECT o_orderkey AS k, -1.7 + (o_orderkey % 480) * 0.01 AS lon1, 42.0 + ((o_orderkey * 7) % 115) * 0.01 AS lat1,
 -1.7 + (o_orderkey % 479) * 0.01 AS lon2, 42.0 + ((o_orderkey * 5) % 113) * 0.01 AS lat2 FROM orders
"""
#: A terrain of 50 columns on ``part``: a valley with small pits.
CELL = """
SELECT CAST(floor(p_partkey/50) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
 CAST(1000 + 7*floor(p_partkey/50) + 5*abs(p_partkey % 50 - 25) + p_size % 4 AS DOUBLE) AS z FROM part
"""
#: The same rows as a rough terrain: pits, ridges and lakes of equal height, a gap in every 89th place.
ROUGH = """
SELECT CAST(floor(p_partkey/50) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
 CAST(100 + (CAST(floor(p_partkey/50) AS INT) * 37 + (p_partkey % 50) * 101 + p_size * 13) % 23 + 3 * abs(p_partkey % 17 - 8) AS DOUBLE) AS z
FROM part WHERE p_partkey % 89 > 0 AND NOT (p_partkey % 50 BETWEEN 20 AND 32 AND floor(p_partkey/50) % 20 BETWEEN 7 AND 15)
UNION ALL SELECT CAST(floor(p_partkey/50) AS INT), CAST(p_partkey % 50 AS INT), CAST(90 AS DOUBLE) FROM part
WHERE p_partkey % 89 > 0 AND p_partkey % 50 BETWEEN 20 AND 32 AND floor(p_partkey/50) % 20 BETWEEN 7 AND 15
"""
#: Unit squares on ``customer``, 40 to a row, each keyed to a river; they abut, so a dissolve is exact.
BASIN = """
SELECT c_custkey AS basin, concat('CDE_', 2 * CAST(floor(c_custkey / 7) AS BIGINT) + 1) AS river_id,
 CAST(c_custkey % 40 AS INT) AS x, CAST(floor(c_custkey / 40) AS INT) AS y FROM customer
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above over the tables of ``sf_dir``."""
    for name in ("orders", "part", "customer", "supplier", "events"):
        if f"FROM {name}" in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"_rillway_{name}")
            sql = sql.replace(f"FROM {name}", f"FROM _rillway_{name}")
    return spark.sql(sql)
