"""Report queries kept as SQL over temporary views: the same text runs on Spark and as the check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

#: name -> (tables, SQL)
SQL = {
    "report_cohorts": (["orders"], "SELECT DISTINCT o_orderpriority AS cohort FROM orders"),
    "report_popularity_by_cohort": (["orders", "customer"], "SELECT o_orderpriority AS cohort, CASE WHEN c_acctbal <= 0 THEN 'low' WHEN c_acctbal <= 1800 THEN 'medium' ELSE 'high' END AS popularity, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "report_languages_by_cohort": (["orders", "lineitem"], "SELECT o_orderpriority AS cohort, l_returnflag AS language, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2"),
    "report_domains_by_cohort": (["orders", "customer"], "SELECT o_orderpriority AS cohort, c_mktsegment AS domain, count(*) AS prs, count(DISTINCT o_custkey) AS repositories FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "report_confidences": (["customer"], "SELECT DISTINCT c_mktsegment AS domain, c_custkey AS repository, c_acctbal AS confidence FROM customer WHERE c_acctbal IS NOT NULL"),
    "report_attrition": (["events"], "SELECT event_type AS cohort, day(ts) % 5 AS label, count(*) AS total, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS available FROM events GROUP BY 1, 2"),
    "report_groups": (["part"], "SELECT DISTINCT p_brand AS grp FROM part WHERE trim(p_brand) <> ''"),
    "report_group_values": (["part"], "SELECT p_brand AS grp, p_partkey, p_retailprice AS value FROM part WHERE p_retailprice IS NOT NULL"),
    "report_levels": (["orders", "lineitem"], "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT o_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN n ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN l_returnflag = 'N' THEN n ELSE 0 END) AS BIGINT) AS medium, CAST(sum(CASE WHEN l_returnflag = 'R' THEN n ELSE 0 END) AS BIGINT) AS high FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "report_eligible": (["orders"], "SELECT o_orderstatus AS grp, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1"),
    "report_paired": (["lineitem"], "SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS before, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS after, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) - max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS delta FROM lineitem GROUP BY l_orderkey"),
    "report_composition": (["orders", "lineitem"], "SELECT o_orderpriority AS cohort, l_linestatus AS level, sum(l_quantity) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus IN ('O', 'F') GROUP BY 1, 2"),
    "report_statistics": (["orders", "lineitem", "customer", "events"], """WITH keys AS (SELECT o_orderpriority AS cohort FROM orders UNION SELECT 'events' UNION SELECT 'customers' UNION SELECT 'none'),
        prs AS (SELECT o_orderpriority AS cohort, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT 'events' AS cohort, count(*) AS n FROM events), c AS (SELECT 'customers' AS cohort, count(*) AS n FROM customer)
        SELECT keys.cohort, coalesce(prs.n, 0) AS prs, coalesce(e.n, 0) AS events, coalesce(c.n, 0) AS customers FROM keys LEFT JOIN prs ON prs.cohort = keys.cohort LEFT JOIN e ON e.cohort = keys.cohort LEFT JOIN c ON c.cohort = keys.cohort"""),
    "report_metadata": (["part"], "SELECT p_brand AS grp, count(*) AS considered, count(DISTINCT p_type) AS versions, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1"),
}


def _query(tables: list[str], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_bound(sql, tables), **{t: read_table(spark, sf_dir, t) for t in tables})

    return run


def _bound(sql: str, tables: list[str]) -> str:
    """The text with each table's name as a parameter, so that no view is left behind."""
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    return sql


QUERIES = {name: (_query(tables, sql), sql) for name, (tables, sql) in SQL.items()}
