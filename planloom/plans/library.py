"""Named plans over the star schema, one or more for every relational operator.

Each is kept in its text form; a few are given as SQL or without their join, to run
through the SQL front end and the analyzer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.plans.analyze import analyze
from planloom.plans.catalog import star_catalog
from planloom.plans.compile import compile_plan, oracle_sql, output_names
from planloom.plans.logical import LogicalQuery
from planloom.plans.sqlform import lower, render
from planloom.plans.textform import decode, encode

_OC = "J customer orders.o_custkey customer.c_custkey"
_LP = "J part lineitem.l_partkey part.p_partkey"

PLANS = {
    "project_single": "T region | S r_name",
    "project_multi": "T nation | S n_name,n_regionkey",
    "project_star": "T region | S *",
    "project_qualified_star": "T nation | S nation.* | J region nation.n_regionkey region.r_regionkey",
    "project_duplicate": "T region | S r_name,r_regionkey,r_name",
    "distinct_single": "T customer | S c_mktsegment | D",
    "distinct_pair": "T lineitem | S l_returnflag,l_linestatus | D",
    "distinct_filter": "T orders | S o_orderpriority | D | F AND o_totalprice > 400000",
    "distinct_join": f"T orders | S customer.c_mktsegment,orders.o_orderstatus | D | {_OC}",
    "filter_eq_text": "T orders | S o_orderkey,o_orderstatus | F AND o_orderstatus = 'F'",
    "filter_eq_num": "T part | S p_partkey,p_size | F AND p_size = 10",
    "filter_gt": "T orders | S o_orderkey,o_totalprice | F AND o_totalprice > 300000.5",
    "filter_lt": "T customer | S c_custkey,c_acctbal | F AND c_acctbal < 0",
    "filter_ge": "T lineitem | S l_orderkey,l_quantity | F AND l_quantity >= 49",
    "filter_le": "T lineitem | S l_orderkey,l_quantity | F AND l_quantity <= 2",
    "filter_and2": "T orders | S o_orderkey | F AND o_orderstatus = 'O' & o_totalprice > 250000",
    "filter_and3": "T lineitem | S l_orderkey,l_linenumber | F AND l_returnflag = 'R' & l_quantity > 40 & l_discount <= 0.05",
    "filter_or2": "T orders | S o_orderkey,o_orderstatus | F OR o_orderstatus = 'F' & o_orderstatus = 'P'",
    "filter_or3": "T customer | S c_custkey | F OR c_mktsegment = 'BUILDING' & c_mktsegment = 'MACHINERY' & c_acctbal > 9000",
    "filter_or4": "T part | S p_partkey | F OR p_size = 1 & p_size = 2 & p_size = 3 & p_size = 50",
    "filter_quote_escape": "T region | S r_name | F OR r_name = 'L''Europe' & r_name = 'EUROPE'",
    "filter_text_as_number": "T region | S r_regionkey,r_name | F AND r_regionkey >= '2'",
    "join_project": f"T orders | S orders.o_orderkey,customer.c_name | {_OC}",
    "join_filter_parent": f"T orders | S orders.o_orderkey | {_OC} | F AND customer.c_mktsegment = 'BUILDING'",
    "join_filter_child": f"T orders | S customer.c_name,orders.o_totalprice | {_OC} | F AND orders.o_totalprice > 450000",
    "join_filter_both": f"T orders | S orders.o_orderkey,customer.c_custkey | {_OC} | F AND orders.o_orderstatus = 'F' & customer.c_acctbal > 5000",
    "join_or": f"T orders | S orders.o_orderkey | {_OC} | F OR orders.o_totalprice > 490000 & customer.c_acctbal > 9900",
    "join_lineitem_part": f"T lineitem | S lineitem.l_orderkey,lineitem.l_linenumber,part.p_brand | {_LP} | F AND part.p_size = 5",
    "join_lineitem_orders": "T lineitem | S orders.o_orderkey,lineitem.l_linenumber | J orders lineitem.l_orderkey orders.o_orderkey | F AND orders.o_totalprice > 400000",
    "join_lineitem_supplier": "T lineitem | S supplier.s_name,lineitem.l_orderkey,lineitem.l_linenumber | J supplier lineitem.l_suppkey supplier.s_suppkey | F AND supplier.s_acctbal < 0",
    "join_customer_nation": "T customer | S customer.c_name,nation.n_name | J nation customer.c_nationkey nation.n_nationkey",
    "join_supplier_nation": "T supplier | S supplier.s_name,nation.n_name | J nation supplier.s_nationkey nation.n_nationkey",
    "join_nation_region": "T nation | S nation.n_name,region.r_name | J region nation.n_regionkey region.r_regionkey",
    "join_labels_documents": "T labels | S documents.doc_id,documents.lang,labels.quality | J documents labels.doc_id documents.doc_id",
    "count_star": "T orders | A COUNT * 0",
    "count_col": "T lineitem | A COUNT l_shipdate 0",
    "sum": "T lineitem | A SUM l_quantity 0",
    "sum_int": "T part | A SUM p_size 0",
    "avg": "T orders | A AVG o_totalprice 0",
    "min_num": "T part | A MIN p_retailprice 0",
    "max_num": "T part | A MAX p_retailprice 0",
    "min_text": "T nation | A MIN n_name 0",
    "max_text": "T customer | A MAX c_name 0",
    "agg_filter_count": "T orders | A COUNT * 0 | F AND o_orderstatus = 'P'",
    "agg_filter_sum": "T lineitem | A SUM l_extendedprice 0 | F AND l_returnflag = 'A'",
    "agg_filter_avg": "T lineitem | A AVG l_discount 0 | F AND l_quantity > 30",
    "agg_filter_min": "T orders | A MIN o_totalprice 0 | F AND o_orderpriority = '1-URGENT'",
    "agg_filter_max": "T orders | A MAX o_totalprice 0 | F AND o_orderstatus = 'F'",
    "agg_sum_empty": "T orders | A SUM o_totalprice 0 | F AND o_orderstatus = 'none'",
    "agg_join_count": f"T orders | A COUNT * 0 | {_OC} | F AND customer.c_mktsegment = 'MACHINERY'",
    "agg_join_sum": f"T lineitem | A SUM lineitem.l_quantity 0 | {_LP} | F AND part.p_size > 25",
    "agg_join_avg": f"T orders | A AVG orders.o_totalprice 0 | {_OC} | F AND customer.c_acctbal > 0",
    "agg_join_min": f"T orders | A MIN orders.o_totalprice 0 | {_OC} | F AND customer.c_mktsegment = 'BUILDING'",
    "agg_join_max": f"T lineitem | A MAX part.p_retailprice 0 | {_LP} | F AND lineitem.l_quantity > 45",
    "agg_join_multi_filter": f"T orders | A COUNT * 0 | {_OC} | F AND customer.c_mktsegment = 'BUILDING' & orders.o_orderstatus = 'O' & orders.o_totalprice > 100000",
    "group_count": "T orders | S o_orderstatus | A COUNT * 1 | G o_orderstatus",
    "group_sum": "T lineitem | S l_returnflag | A SUM l_extendedprice 1 | G l_returnflag",
    "group_avg": "T orders | S o_orderpriority | A AVG o_totalprice 1 | G o_orderpriority",
    "group_min": "T part | S p_brand | A MIN p_retailprice 1 | G p_brand",
    "group_max": "T part | S p_type | A MAX p_size 1 | G p_type",
    "group_two_keys": "T lineitem | S l_returnflag,l_linestatus | A COUNT * 2 | G l_returnflag,l_linestatus",
    "group_filter": "T events | S event_type | A COUNT * 1 | F AND value > 50 | G event_type",
    "group_join": f"T orders | S customer.c_mktsegment | A SUM orders.o_totalprice 1 | {_OC} | G customer.c_mktsegment",
    "group_join_filter": f"T orders | S orders.o_orderpriority | A COUNT * 1 | {_OC} | F AND customer.c_mktsegment = 'BUILDING' | G orders.o_orderpriority",
    "group_agg_first": "T customer | S c_mktsegment | A COUNT * 0 | G c_mktsegment",
    "order_asc_limit": "T customer | S c_custkey,c_name | O c_custkey ASC | L 10",
    "order_desc_limit": "T orders | S o_orderkey,o_totalprice | O o_orderkey DESC | L 25",
    "order_filter_limit": "T orders | S o_orderkey | F AND o_orderstatus = 'F' | O o_orderkey ASC | L 15",
    "order_join_limit": f"T orders | S orders.o_orderkey,customer.c_name | {_OC} | O orders.o_orderkey DESC | L 12",
    "order_hidden_key_limit": "T part | S p_name | O p_partkey ASC | L 20",
    "group_order_limit": "T part | S p_brand | A COUNT * 1 | G p_brand | O p_brand ASC | L 5",
    "distinct_order_limit": "T lineitem | S l_suppkey | D | O l_suppkey DESC | L 7",
}

SQL = {
    "sql_lowered": "SELECT c.c_mktsegment AS segment, COUNT(*) FROM orders AS o JOIN customer c ON (o.o_custkey = c.c_custkey) WHERE (o.o_totalprice > 100000 AND c.c_acctbal >= 0) GROUP BY c.c_mktsegment ORDER BY segment",
    "alias_lowered": "SELECT n.n_name nation_name, r.r_name FROM nation n INNER JOIN region AS r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'ASIA' ORDER BY nation_name DESC LIMIT 3;",
}

#: The join is left to the analyzer.
INFERRED = {
    "join_inferred": "T orders | S o_orderkey,c_name | F AND c_mktsegment = 'FURNITURE'",
    "join_inferred_group": "T nation | S r_name | A COUNT * 1 | G r_name",
}

DIGITS = 2
FLAGSHIP = "group_join_filter"


def plan(key: str) -> LogicalQuery:
    if key in SQL:
        return lower(SQL[key])
    if key == "dsl_roundtrip":
        return decode(encode(decode(PLANS["group_join_filter"])))
    if key == "sql_roundtrip":
        return lower(render(decode(PLANS["agg_join_multi_filter"])))
    return decode(PLANS.get(key) or INFERRED[key])


KEYS = (*PLANS, *SQL, *INFERRED, "dsl_roundtrip", "sql_roundtrip")


def rounded(catalog, chosen: LogicalQuery, df: DataFrame) -> DataFrame:
    """Sums and averages of doubles to DIGITS digits: engines add in different orders."""
    chosen = analyze(catalog, chosen)
    if chosen.aggregate not in ("SUM", "AVG"):
        return df
    name = output_names(catalog, chosen)[chosen.position + len(df.columns) - len(chosen.columns) - 1]
    return df.withColumn(name, F.round(name, DIGITS)) if dict(df.dtypes)[name] == "double" else df


def query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = star_catalog(spark, sf_dir)
        return rounded(catalog, plan(key), compile_plan(catalog, plan(key)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query(key) for key in KEYS}


def oracles() -> dict[str, str]:
    catalog = star_catalog()
    return {key: oracle_sql(catalog, plan(key), DIGITS) for key in KEYS}
