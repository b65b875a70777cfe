"""Queries on networks that fork, run deep, or turn in circles, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.operators import catalog as C
from rillway.operators import rivers as R
from rillway.plans.tables import written
from rillway.plans.views import view

#: Rivers on ``customer``: k flows into k/2, every third also into 2k/3, every fifth also into 4k/5.
FORK = """
SELECT concat('R', k) AS src, concat('R', CAST(floor(k / 2) AS BIGINT)) AS dst FROM (SELECT c_custkey + 1 AS k FROM customer) WHERE k > 1
UNION SELECT concat('R', k), concat('R', CAST(k * 2 / 3 AS BIGINT)) FROM (SELECT c_custkey + 1 AS k FROM customer) WHERE k % 3 = 0
UNION SELECT concat('R', k), concat('R', CAST(k * 4 / 5 AS BIGINT)) FROM (SELECT c_custkey + 1 AS k FROM customer) WHERE k % 5 = 0
"""
#: One chain of all customers.
CHAIN = "SELECT concat('R', c_custkey) AS src, concat('R', c_custkey - 1) AS dst FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)"
#: Nameless segments, ten to a group: five in a row that end in a ring of the other five, at a place of its own.
WHIRL = """
SELECT concat('T', c_custkey) AS cleabs, concat('N', lpad(CAST(c_custkey AS STRING), 9, '0')) AS src,
 concat('N', lpad(CAST(CASE WHEN c_custkey % 10 < 4 THEN c_custkey + 1 WHEN c_custkey % 10 = 4 THEN c_custkey + 1 + floor(c_custkey / 10) % 5
  WHEN c_custkey % 10 = 9 THEN c_custkey - 4 ELSE c_custkey + 1 END AS STRING), 9, '0')) AS dst, CAST(NULL AS STRING) AS river_key FROM customer
"""


def _links(spark, sf, sql=FORK):
    return written(view(spark, sf, sql))


def _rivers(links):
    first = links.groupBy(F.col("src").alias("river_id")).agg(F.min("dst").alias("parent_id"))
    every = links.select(F.col("src").alias("river_id")).union(links.select("dst")).distinct()
    return written(every.join(first, "river_id", "left"))


def q_also(spark, sf):
    return C.also_flows_into(_links(spark, sf))


def q_forked_sums(spark, sf):
    """How many rivers drain into each over all links, and the sum of their numbers' last two digits."""
    links = _links(spark, sf)
    rivers = _rivers(links)
    values = rivers.select("river_id", F.lit(1).cast("long").alias("n"), (F.expr("cast(substring(river_id, 2) as bigint)") % 100).alias("w"))
    return R.upstream_sums(rivers, links, values, ["n", "w"])


def q_chain(spark, sf):
    links = _links(spark, sf, CHAIN)
    rivers = _rivers(links)
    return R.n_upstream(R.Network(None, None, rivers, links)).select("river_id", F.col("n_upstream").cast("long").alias("n_upstream"))


def q_whirl(spark, sf):
    return R.resolve_unnamed(written(view(spark, sf, WHIRL)))


_UP = f"link AS ({FORK}), up(river_id, anc) AS (SELECT dst, src FROM link UNION SELECT u.river_id, l.src FROM up u JOIN link l ON l.dst = u.anc), every AS (SELECT river_id, anc FROM up UNION SELECT src, src FROM link UNION SELECT dst, dst FROM link)"

QUERIES = {
    "also_flows_into": (q_also, f"WITH link AS ({FORK}) SELECT src AS river_id, dst AS also FROM link l WHERE dst > (SELECT min(dst) FROM link m WHERE m.src = l.src)"),
    "forked_upstream_sums": (q_forked_sums, f"WITH RECURSIVE {_UP} SELECT river_id, count(*) AS n, CAST(sum(CAST(substring(anc, 2) AS BIGINT) % 100) AS BIGINT) AS w FROM every GROUP BY river_id"),
    "chain_upstream": (q_chain, "SELECT concat('R', c_custkey) AS river_id, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS n_upstream FROM customer"),
    "resolve_cycles": (q_whirl, "SELECT concat('T', c_custkey) AS cleabs, concat('UNNAMED:N', lpad(CAST(CAST(floor(c_custkey / 10) AS BIGINT) * 10 + 5 + CAST(floor(c_custkey / 10) AS BIGINT) % 5 AS VARCHAR), 9, '0')) AS river_id FROM customer"),
}
