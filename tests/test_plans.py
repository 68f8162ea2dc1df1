import random

import duckdb
import pytest

from planloom.plans import library
from planloom.plans.analyze import analyze
from planloom.plans.catalog import ForeignKey, fingerprint, from_metadata, parse_ddl, slots, star_catalog
from planloom.plans.compile import bounded, compile_plan, oracle_sql, run_text
from planloom.plans.errors import AnalysisError, PlanError, Rejected, SqlRejected
from planloom.plans.logical import LogicalQuery, Predicate, Slot, difficulty, family, from_struct, signature, tier, to_struct
from planloom.plans.sqlform import is_read_only, is_safe_context, lower, normalize, render
from planloom.plans.textform import PrefixGrammar, decode, encode

FULL = LogicalQuery(
    "loans", ("members.town",), aggregate="COUNT", aggregate_position=1, distinct=True, join_table="members", join_on=("loans.member_id", "members.member_id"),
    predicates=(Predicate("loans.state", "=", "it's a & b | c"), Predicate("loans.fee", ">=", 2.5)), connector="OR", group_by=("members.town",), order_by="members.town", descending=True, limit=4,
)
DDL = "CREATE TABLE members (member_id INTEGER PRIMARY KEY, name TEXT, town TEXT);\nCREATE TABLE loans (loan_id INTEGER PRIMARY KEY, member_id INTEGER REFERENCES members(member_id), fee REAL, state TEXT);"


@pytest.fixture(scope="module")
def small(spark):
    catalog = parse_ddl(DDL)
    members = spark.createDataFrame([(1, "Ann", "Arden"), (2, "Bo", "Belmora"), (3, None, "Arden")], "member_id long, name string, town string")
    loans = spark.createDataFrame([(1, 1, 2.0, "open"), (2, 1, 5.5, "held"), (3, 2, 9.0, "open"), (4, 3, None, "it's a & b | c")], "loan_id long, member_id long, fee double, state string")
    catalog.frames = {"members": lambda: members, "loans": lambda: loans}
    return catalog


def test_text_form_round_trip():
    text = encode(FULL)
    assert text == "T loans | S members.town | A COUNT * 1 | D | J members loans.member_id members.member_id | F OR loans.state = 'it''s a & b | c' & loans.fee >= 2.5 | G members.town | O members.town DESC | L 4"
    assert decode(text) == FULL
    assert decode("L 3 | S a,b | T t").limit == 3
    assert from_struct(to_struct(FULL)) == FULL
    assert decode("T t | S a | F AND b = value2").predicates[0].value == Slot("value2")
    literal = LogicalQuery("t", ("a",), predicates=(Predicate("b", "=", "value2"),))
    assert decode(encode(literal)) == literal


@pytest.mark.parametrize("text, reason", [
    ("", "empty_plan"), ("T t", "missing_selection"), ("S a", "missing_table"), ("T t | S a | X 1", "unknown_clause"), ("T t | S a | S b", "duplicate_clause"), ("T t | S a; DROP", "invalid_reference"),
    ("T t | S a | F AND b = 'x", "unterminated_quote"), ("T t | S a | L 0", "bad_limit"), ("T t | A SUM * 0", "star_non_count_aggregate"), ("T t | A COUNT * 1", "position_too_large"), ("T t | S a | D x", "distinct_takes_no_value"),
    ("T t | S a | J u x", "bad_join"), ("T t | S a | F XOR b = 1", "bad_filter"), ("T t | S a | F AND b like 1", "bad_predicate"), ("T t | S a | F AND b = 01", "bad_literal"), ("T t | S a | O b", "bad_order"), ("T t |  | S a", "empty_clause"), ("T t | S ,", "empty_selection"),
])
def test_text_form_rejects(text, reason):
    with pytest.raises(PlanError) as e:
        decode(text)
    assert e.value.reason == reason


def test_every_prefix_of_a_plan_is_accepted():
    grammar = PrefixGrammar({"members": ("member_id", "name", "town"), "loans": ("loan_id", "member_id", "fee", "state")})
    plans = [FULL.replace(predicates=(Predicate("loans.state", "=", "it's"), Predicate("fee", ">=", -2.5), Predicate("fee", "<", Slot("value12")))), LogicalQuery("members", ("*",)), LogicalQuery("loans", aggregate="SUM", aggregate_column="fee", predicates=(Predicate("fee", ">", 3),), limit=12)]
    for plan in plans:
        text = encode(plan)
        for end in range(len(text) + 1):
            assert grammar.is_prefix(text[:end]), text[:end]
        assert grammar.is_complete(text)
    for bad in ("X", "T ghosts", "S name", "T loans | F", "T loans | S ghost", "T loans | A SUM *", "T loans | S fee | S", "T loans | S fee | F AND fee = 1 & fee = 1 & fee = 1 & fee = 1 & f", "T loans | S fee | F AND fee = 'a;"):
        assert not grammar.is_prefix(bad), bad
    assert not grammar.is_complete("T loans") and not grammar.is_complete("T loans | S fee | F AND fee =")


def test_sql_lowers_to_the_plan_and_back():
    sql = "SELECT m.town AS place, COUNT(*) FROM loans AS l JOIN members m ON (l.member_id = m.member_id) WHERE (l.fee >= 2.5 OR l.state = 'it''s') GROUP BY m.town ORDER BY place DESC LIMIT 4;"
    plan = lower(sql)
    assert plan.columns == ("members.town",) and plan.order_by == "members.town" and plan.connector == "OR" and plan.aggregate_position == 1
    assert lower(render(plan)) == plan
    assert lower("select count(*) from t").aggregate_column is None
    assert lower("SELECT a FROM t WHERE b = -3").predicates[0].value == -3


@pytest.mark.parametrize("sql, reason", [
    ("DELETE FROM t", "not_one_select"), ("SELECT a FROM t; SELECT b FROM t", "not_one_select"), ("SELECT a FROM t UNION SELECT b FROM u", "not_one_select"), ("SELECT a FROM (SELECT a FROM t)", "nested_select"), ("WITH x AS (SELECT 1) SELECT a FROM x", "advanced_clause"),
    ("SELECT a, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > 1", "advanced_clause"), ("SELECT a FROM t JOIN u ON t.x = u.x JOIN v ON u.y = v.y", "multiple_joins"), ("SELECT a FROM t LEFT JOIN u ON t.x = u.x", "non_inner_join"), ("SELECT a FROM t JOIN u ON t.x > u.x", "complex_join_condition"),
    ("SELECT a FROM t JOIN t s ON t.x = s.y", "self_join"), ("SELECT a FROM t WHERE b IN (1, 2)", "unsupported_predicate"), ("SELECT a FROM t WHERE b = 1 AND c = 2 OR d = 3", "mixed_filter_connectors"), ("SELECT a FROM t WHERE b = c", "literal_expression"), ("SELECT a FROM t WHERE b + 1 = 2", "column_expression"),
    ("SELECT COUNT(*), SUM(a) FROM t", "unsupported_projection"), ("SELECT SUM(*) FROM t", "star_non_count_aggregate"), ("SELECT COUNT(DISTINCT a) FROM t", "aggregate_expression"), ("SELECT a, COUNT(*) FROM t", "mixed_aggregate_projection"), ("SELECT a, COUNT(*) FROM t GROUP BY b", "unsupported_group_projection"),
    ("SELECT a FROM t ORDER BY a, b", "multiple_order_columns"), ("SELECT a FROM t LIMIT 0", "non_positive_integer_limit"), ("SELECT a FROM t LIMIT 3 OFFSET 2", "offset"), ('SELECT "a" FROM t', "quoted_identifier"), ("SELECT a FROM main.t", "qualified_or_computed_table"), ("SELECT z.a FROM t", "unknown_table_alias"), ("SELECT 1", "missing_from"), ("SELECT a FROM t WHERE b = -'x'", "non_numeric_literal"),
])
def test_sql_rejections(sql, reason):
    with pytest.raises(SqlRejected) as e:
        lower(sql)
    assert e.value.reason == reason


def test_read_only_gate():
    assert is_read_only("SELECT 'drop; table' FROM t;") and is_read_only("select a from t")
    assert not any(map(is_read_only, ("DROP TABLE t", "SELECT 1; DELETE FROM t", "", "SELECT 'x", "SELECT a FROM t WHERE EXISTS (DELETE FROM t)")))
    assert is_safe_context("CREATE TABLE t (a INT); INSERT INTO t VALUES (1);") and not is_safe_context("ATTACH 'x' AS y") and not is_safe_context("DROP TABLE t")
    assert normalize(" SELECT  A\nFROM t ; ") == "select a from t"


def test_catalog_parses_both_key_forms():
    c = parse_ddl("CREATE TABLE a (id INT PRIMARY KEY, v VARCHAR(10) DEFAULT ',');CREATE TABLE b (id INT, a_id INT, PRIMARY KEY (id), FOREIGN KEY (a_id) REFERENCES a(id));")
    assert c.foreign_keys == (ForeignKey("b", "a_id", "a", "id"),) and c.table("B").column("ID").primary_key and c.table("a").columns[1].affinity == "text"
    assert fingerprint(DDL) == fingerprint(DDL.replace(", ", " ,\n  ")) != fingerprint(DDL.replace("town", "city"))
    tables, columns = slots(parse_ddl(DDL))
    assert tables == {"members": "table1", "loans": "table2"} and columns["member_id"] == "column1" and len(columns) == 6
    assert set(slots(parse_ddl(DDL), True)[1].values()) == set(columns.values())
    meta = {"table_names_original": ["a", "b"], "column_names_original": [[-1, "*"], [0, "id"], [1, "a_id"]], "column_types": ["text", "number", "boolean"], "primary_keys": [1], "foreign_keys": [[2, 1]]}
    assert from_metadata(meta).foreign_keys == (ForeignKey("b", "a_id", "a", "id"),)
    with pytest.raises(Rejected, match="case_colliding"):
        from_metadata(meta | {"table_names_original": ["a", "A"]})


def test_analyzer(small):
    plan = analyze(small, decode("T loans | S fee,town"))
    assert plan.join_table == "members" and plan.join_on == ("loans.member_id", "members.member_id") and plan.columns == ("loans.fee", "members.town")
    assert analyze(small, decode("T loans | S members.fee | J members loans.member_id members.member_id")).columns == ("loans.fee",)
    for text, reason in [
        ("T ghosts | S a", "unknown_table"), ("T loans | S ghost", "unknown_column"), ("T loans | S member_id | J members loans.member_id members.member_id", "ambiguous_column"), ("T loans | S fee | J members loans.loan_id members.member_id", "join_is_not_declared_foreign_key"),
        ("T loans | A SUM state 0", "non_numeric_aggregate"), ("T loans | S state | A COUNT * 1", "ungrouped_projection"), ("T loans | S state | D | O fee ASC", "order_by_unselected_distinct"), ("T loans | S state | A COUNT * 1 | G state | O fee ASC", "order_by_ungrouped_column"), ("T loans | S state | G state", "group_without_aggregate"),
    ]:
        with pytest.raises(AnalysisError) as e:
            analyze(small, decode(text))
        assert e.value.reason == reason, text
    two = parse_ddl("CREATE TABLE a (id INT PRIMARY KEY, x INT); CREATE TABLE b (bid INT, p INT REFERENCES a(id), q INT REFERENCES a(id));")
    with pytest.raises(AnalysisError, match="ambiguous_join"):
        analyze(two, decode("T b | S bid,x"))


def test_compiler_semantics(small):
    def rows(text, **values):
        return [tuple(r) for r in run_text(small, text, values or None).collect()]

    assert rows("T members | S name | O name ASC") == [(None,), ("Ann",), ("Bo",)]
    assert rows("T loans | S loan_id | O fee DESC | L 1") == [(3,)]
    assert rows("T loans | A SUM fee 0 | F AND state = 'none'") == [(None,)]
    assert rows("T loans | A COUNT fee 0") == [(3,)] and rows("T loans | A COUNT * 0") == [(4,)]
    assert sorted(rows("T loans | S loan_id | F AND fee < 'abc'")) == [(1,), (2,), (3,)] and rows("T loans | S loan_id | F AND fee > 'abc'") == []
    assert rows("T loans | S loan_id | F AND fee = '9'") == [(3,)]
    assert rows("T loans | S loan_id | F AND state = 'it''s a & b | c'") == [(4,)]
    assert rows("T loans | S loan_id | F AND fee > value1", value1=5.6) == [(3,)]
    assert run_text(small, "T members | S *,name").columns == ["member_id", "name", "town", "members_name"]
    assert run_text(small, "T loans | S state | A COUNT * 0 | G state").columns == ["count_all", "state"]
    assert len(bounded(run_text(small, "T loans | S *"), 2)) == 2
    with pytest.raises(PlanError, match="unbound_slot"):
        rows("T loans | S loan_id | F AND fee > value1", value2=1)


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = compile_plan(star_catalog(spark, sf_dir), library.plan("filter_and3"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in text and "l_comment" not in text
    schema = text.split("ReadSchema: ")[1]
    assert "l_extendedprice" not in schema and "l_quantity" in schema


def test_random_plans_agree_with_another_engine(spark, sf_dir):
    catalog, rng = star_catalog(spark, sf_dir), random.Random(5)
    con = duckdb.connect()
    for t in catalog.tables:
        con.execute(f"CREATE VIEW {t.name} AS SELECT * FROM '{sf_dir}/{t.name}.parquet'")
    for _ in range(12):
        join = rng.random() < 0.5
        pick = [Predicate("orders.o_totalprice", rng.choice((">", "<=")), rng.randint(10_000, 400_000)), Predicate("orders.o_orderstatus", "=", rng.choice("FOP"))]
        if join:
            pick.append(Predicate("customer.c_acctbal", ">", rng.randint(-500, 5000)))
        plan = LogicalQuery("orders", predicates=tuple(rng.sample(pick, 2)), connector=rng.choice(("AND", "OR")), **({"join_table": "customer", "join_on": ("orders.o_custkey", "customer.c_custkey")} if join else {}))
        shape = rng.choice(("project", "group", "distinct"))
        if shape == "group":
            plan = plan.replace(columns=("orders.o_orderpriority",), group_by=("orders.o_orderpriority",), aggregate=rng.choice(("COUNT", "MIN", "MAX")), aggregate_column="orders.o_orderkey", aggregate_position=rng.randint(0, 1))
        else:
            plan = plan.replace(columns=("orders.o_orderkey",) if shape == "project" else ("orders.o_orderpriority",), distinct=shape == "distinct")
        ours = sorted(tuple(r) for r in compile_plan(catalog, plan).collect())
        assert ours == sorted(con.execute(oracle_sql(catalog, plan)).fetchall()), encode(plan)


def test_classification():
    assert family(FULL) == "join" and signature(FULL) == "compose_join_group_count_filter2_or_order_limit" and tier(FULL) == "multi" and difficulty(FULL) == 4
    plain = decode("T t | S a")
    assert family(plain) == "select" and tier(plain) == "atomic" and difficulty(plain) == 1 and signature(plain) == "compose_single_select"
