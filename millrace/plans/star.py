"""The requirement facts of the analysis queries: order lines seen as requirements of adverts.

posting = order, company = customer, industry = market segment, fn = order status, level = priority, cluster = part name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table


def adverts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per advert."""
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.selectExpr(
        "o_orderkey AS posting", "o_custkey AS company", "c_mktsegment AS industry", "n_name AS nation",
        "o_orderstatus AS fn", "o_orderpriority AS level", "o_orderdate AS created_at", "o_totalprice AS amount",
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per requirement of an advert."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    ads = adverts(spark, folder)
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(ads, lines["l_orderkey"] == ads["posting"])
    return joined.selectExpr(
        "posting", "company", "industry", "nation", "fn", "level", "created_at", "p_name AS cluster", "p_brand AS brand",
        "p_type AS type", "p_size AS size", "l_linenumber AS line", "l_quantity AS quantity", "l_returnflag AS flag", "l_linestatus AS linestatus",
    )


ADVERTS_SQL = """adverts AS (SELECT o_orderkey AS posting, o_custkey AS company, c_mktsegment AS industry, n_name AS nation,
o_orderstatus AS fn, o_orderpriority AS level, o_orderdate AS created_at, o_totalprice AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

FACTS_SQL = f"""{ADVERTS_SQL},
facts AS (SELECT posting, company, industry, nation, fn, level, created_at, p_name AS cluster, p_brand AS brand, p_type AS type,
p_size AS size, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS linestatus
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN adverts ON l_orderkey = posting)"""
