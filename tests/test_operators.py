import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.operators import curate, evaluate, generate, links, report, sample
from planloom.operators.ranking import largest_remainder, shuffled_rank
from planloom.plans.catalog import parse_ddl
from planloom.plans.english import assemble, combine, drop_unmentioned, ground, legend, only_known_names, plan_from_slots, plan_to_slots, question_plan, repair_location, schema_of_slots, substitute_roles
from planloom.plans.errors import AnalysisError, Rejected
from planloom.plans.logical import PLAN_STRUCT, LogicalQuery, Predicate, to_struct
from planloom.plans.sqlform import render
from planloom.plans.textform import decode, encode


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, f"q{i % 4}", "abc"[i % 3], f"s{i % 5}", i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "pos long, question string, family string, schema string, sql int")


def ids(df, name="pos"):
    return sorted(r[name] for r in df.select(name).collect())


def test_keep_first_and_conflicts(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "A ", "y"), (3, None, "x"), (4, "", "x"), (5, None, "z"), (6, "a", "x")], "pos long, q string, sql string")
    assert ids(curate.keep_first(df, [text.folded("q")], "pos")) == [1, 3, 4]
    assert tuple(curate.duplicate_count(df, [text.folded("q")]).first()) == (6, 3, 3)
    assert ids(curate.exclude_conflicts(df, [text.folded("q")], "sql", "pos")) == [1, 3, 4, 6]
    assert [tuple(r) for r in curate.conflict_audit(df.where("q = 'a' OR q = 'A '").withColumn("q", text.folded("q")), ["q"], "sql").collect()] == [("a", 2)]
    empty = df.limit(0)
    assert curate.keep_first(empty, ["q"], "pos").count() == 0 and tuple(curate.duplicate_count(empty, ["q"]).first()) == (0, 0, 0)


def test_contamination(spark):
    own = spark.createDataFrame([(1, "s", "q", "x"), (2, "s", "q2", "y"), (3, "t", "q", "z")], "pos long, schema string, question string, sql string")
    frozen = spark.createDataFrame([(9, "s", "q", "w"), (8, "t", "other", "z")], own.schema)
    columns = {c: F.col(c) for c in ("schema", "question", "sql")}
    kept, log = curate.decontaminate(own, frozen, columns)
    assert ids(kept) == [2] and sorted(map(tuple, log.collect())) == [("training_contamination:schema_question", 1), ("training_contamination:schema_sql", 1)]
    with pytest.raises(Rejected, match="splits_overlap"):
        curate.assert_isolated(own.withColumn("split", F.col("question")), "split", "schema")
    with pytest.raises(Rejected, match="training_use"):
        curate.assert_permitted(own, F.lit(None).cast("boolean"))


def test_samples_are_exact_and_repeatable(records):
    a = ids(sample.exact_sample(records, 17, ["pos"], 3))
    assert len(set(a)) == 17 and a == ids(sample.exact_sample(records.repartition(7), 17, ["pos"], 3)) != ids(sample.exact_sample(records, 17, ["pos"], 4))
    with pytest.raises(Rejected):
        sample.exact_sample(records, 61, ["pos"], 3)
    cycles = sample.cycle_sample(records, 130, ["pos"], 1)
    assert cycles.count() == 130 and {r["cycle"]: r["count"] for r in cycles.groupBy("cycle").count().collect()} == {0: 60, 1: 60, 2: 10}
    ranks = shuffled_rank(records, ["family"], ["pos"], 5).groupBy("family").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(1, 21)) for r in ranks)


def test_splits_keep_groups_whole(records):
    split = sample.split_groups(records, "schema", 1)
    assert split.count() == 60 and curate.overlapping(split, "split", "schema").isEmpty() and {r["split"] for r in split.collect()} == {"train", "validation", "test"}


def test_quotas_and_takes(records, spark):
    assert sorted(r["quota"] for r in sample.quotas(records, "family", 11).collect()) == [3, 4, 4]
    odd = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0)], "k string, w double")
    assert {r["k"]: r["quota"] for r in largest_remainder(odd, "w", 5, ["k"]).collect()} == {"a": 3, "b": 2, "c": 0}
    wide = records.withColumn("group", F.floor(F.col("pos") / 2))
    taken = sample.balanced_take(wide, "family", "group", ["pos"], 20, 2)
    assert taken.count() == 20 == taken.select("group").distinct().count()
    with pytest.raises(Rejected, match="quota_not_reached"):
        sample.balanced_take(wide, "family", "group", ["pos"], 40, 2, strict=True)
    turns = sample.round_robin(records, "schema", "family", ["pos"], 5, 1).collect()
    assert len({r["schema"] for r in turns}) == 5
    heavy = sample.weighted_resample(records, "family", {"a": 8.0}, ["pos"], 100, 1)
    assert heavy.count() == 100 and {r["family"]: r["count"] for r in heavy.groupBy("family").count().collect()}["a"] == 80
    mixed = sample.mix_sources({"x": records, "y": records}, {"x": 3, "y": 1}, 41, ["pos"], 1, "pos")
    assert {r["mix_source"]: r["count"] for r in mixed.groupBy("mix_source").count().collect()} == {"x": 31, "y": 10} and mixed.first()["pos"].split(":")[0] in "xy"
    assert sample.mix_fraction(records, records, 0.25, ["pos"], 1).count() == 80 and sample.mix_fraction(records, records, 0.25, ["pos"], 1, total=40).count() == 40
    first = [r["family"] for r in sample.interleaved(records, "family", {"a": 2.0}, ["pos"], 1).limit(8).collect()]
    assert first.count("a") == 4


def test_reports(records, spark):
    assert report.length_audit(records, "pos", 50, F.lit(True)).first().asDict() == {"rows": 60, "complete": 50, "partial": 0, "zero": 1, "over_limit": 9, "longest": 59}
    with pytest.raises(Rejected, match="incomplete"):
        report.require_complete(report.length_audit(records, "pos", 50, F.lit(True)))
    mark = report.manifest(records, "pos", F.to_json(F.struct("*")))
    assert mark == report.manifest(records.repartition(5), "pos", F.to_json(F.struct("*"))) != report.manifest(records.where("pos > 0"), "pos", F.to_json(F.struct("*"))) and mark[1] == 60
    plans = spark.createDataFrame([(to_struct(decode("T t | A SUM a 0 | F OR b = 1 & c > 2")),)], f"plan {PLAN_STRUCT}")
    assert sorted(map(tuple, report.distribution(plans, "plan").collect())) == [("aggregate", "SUM", 1), ("connector", "OR", 1), ("operator", "=", 1), ("operator", ">", 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße  ﬁn",), (None,)], "t string")
    assert [r[0] for r in df.select(text.nfkc_fold("t")).collect()] == ["strasse fin", None]
    assert text.header_identifiers(["Größe (m)", "2nd", "select", "", "Größe (m)"]) == ["groe_m", "c_2nd", "field_select", "column", "groe_m_2"]
    assert [text.number(x) for x in ("1,234", "abc", "3.50 kg", None, "-7", 10**30)] == [1234, None, 3.5, None, -7, 1e30]
    assert text.singular("cities") == "city" and text.plural("box") == "boxes" and text.identifier_words("tbl_customerRecords") == ("customer", "records")
    assert text.mentions("from New York!", "new york") and not text.mentions("Yorkshire", "York")
    assert [r[0] for r in spark.createDataFrame([("1,5 x",), ("z",)], "t string").select(text.number_column("t")).collect()] == [15.0, None]


def test_scoring_and_metrics(spark):
    script = "CREATE TABLE t (id INTEGER, name TEXT); INSERT INTO t VALUES (1, 'a'), (2, NULL);"
    gold = {"sql": "SELECT id FROM t ORDER BY id", "plan": to_struct(decode("T t | S id | O id ASC"))}
    cases = [("SELECT id FROM t ORDER BY id", "correct_execution"), ("SELECT id FROM t ORDER BY id DESC", "wrong_result"), ("SELECT ghost FROM t", "execution_error"), ("DROP TABLE t", "unsafe_or_incomplete_output"), (None, "unsafe_or_incomplete_output")]
    df = spark.createDataFrame([(i, script, gold["sql"], p, gold["plan"], "g", "c", ("direct_identifier", "semantic_paraphrase")[i % 2], i // 2) for i, (p, _) in enumerate(cases)], f"pos long, schema_sql string, sql string, prediction string, query_plan {PLAN_STRUCT}, grp string, change string, track string, pair int")
    scored = evaluate.score(df, has_plan=True)
    rows = sorted(scored.collect(), key=lambda r: r["pos"])
    assert [r["failure"] for r in rows] == [f for _, f in cases] and rows[0]["components"]["plan_match"] == 1 and rows[1]["components"]["order_limit"] == 0
    assert evaluate.overall(scored).first()["execution_accuracy_given_valid"] == pytest.approx(1 / 3)
    pairs = evaluate.paired_tracks(scored, "pair", "track").first()
    assert (pairs["pairs"], pairs["direct_accuracy"], pairs["rescue"]) == (2, 0.5, 0.0)
    assert evaluate.counterfactual(scored, "grp", "change", 5).first()["accuracy"] == 0
    assert evaluate.equivalent([(1,)], [(1.0,)], False) and not evaluate.equivalent(None, None, False) and not evaluate.equivalent([(1,), (2,)], [(2,), (1,)], True)
    assert evaluate.execute(script, "SELECT COUNT(*) FROM t, t a, t b") == [(8,)]
    empty = evaluate.overall(scored.limit(0)).first()
    assert empty["records"] == 0 and empty["execution_accuracy"] == 0
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double")
    assert sorted(map(tuple, evaluate.bag_difference(a, b).collect())) == [(1.0, "left", 1), (2.0, "right", 1)] and evaluate.same_bag(a, a)


def test_oracles(spark):
    gold = decode("T orders | S id | F AND status = 'x' | O id DESC")
    own = decode("T ghosts | S total | F AND city > 'x'")
    assert evaluate.with_schema_links(own, gold, "all_but_filters").table == "orders" and evaluate.with_schema_links(own, gold, "filters").predicates[0].column == "status"
    assert evaluate.with_operations(own, gold).predicates[0].operator == "=" and evaluate.with_literals(own, gold).predicates[0].value == "x"
    df = spark.createDataFrame([(to_struct(own), to_struct(gold))], f"predicted_plan {PLAN_STRUCT}, query_plan {PLAN_STRUCT}")
    out = {r["variant"]: r["prediction"] for r in evaluate.oracle_predictions(df).collect()}
    assert out["all"] == "SELECT id FROM orders WHERE status > 'x'" and len(out) == 12


def test_operation_match(spark):
    plans = [decode(x) for x in ("T a | S x | F AND y = 'Paid' & z > 3", "T b | S q | F AND r > 3 & s = 'pAID'", "T b | S q | F AND r = 3 & s > 'paid'", "T a | S x,y | F OR y = '3' | O x DESC | L 2", "T a | A SUM x 0", "T a | S y | A COUNT * 1 | G y")]
    rows = [(i, j, to_struct(a), to_struct(b)) for i, a in enumerate(plans) for j, b in enumerate(plans)] + [(-1, 0, None, to_struct(plans[0]))]
    df = spark.createDataFrame(rows, f"i int, j int, a {PLAN_STRUCT}, b {PLAN_STRUCT}")
    for r in df.select("i", "j", evaluate.operation_match("a", "b").alias("o")).collect():
        assert (r["o"] and r["o"].asDict()) == (evaluate.operations_of(plans[r["i"]], plans[r["j"]]) if r["i"] >= 0 else None)
    assert evaluate.operations_of(plans[0], plans[1])["all_operations"] == 1
    swapped = evaluate.operations_of(plans[1], plans[2])
    assert swapped["filter_values"] == 1 and swapped["filter_operators_and_values"] == 0
    told = evaluate.oracle_availability(df, predicted="a", gold="b").first()
    assert (told["records"], told["parsed"]) == (37, 36) and 0 < told["limit"] < 1


def test_oracle_report(spark):
    script = "CREATE TABLE t (id INTEGER, v INTEGER, s TEXT); INSERT INTO t VALUES (1, 5, 'a'), (2, 7, 'b')"
    gold = to_struct(decode("T t | S id | F AND s = 'b'"))
    cases = [(0, to_struct(decode("T t | S v | F AND s = 'b'")), "SELECT id FROM t WHERE s = 'b'"), (1, to_struct(decode("T t | S id | F AND s = 'a'")), "SELECT v FROM t"), (2, None, None), (3, gold, "DROP TABLE t")]
    df = spark.createDataFrame([(i, "SELECT id FROM t WHERE s = 'b'", script, p, own, gold) for i, own, p in cases], f"id int, sql string, database_sql string, production string, predicted_plan {PLAN_STRUCT}, query_plan {PLAN_STRUCT}")
    got = {r["variant"]: r for r in evaluate.oracle_report(df, "id").collect()}
    right = {v: r["execution_accuracy"] for v, r in got.items()}
    assert all(r["records"] == 4 for r in got.values()) and len(got) == 19
    assert (right["production"], right["none"], right["projection"], right["literals"], right["schema_and_literals"], right["gold_plan"]) == (0.25, 0.25, 0.5, 0.5, 0.75, 1.0)
    assert (right["rescue_all"], right["rescue_literals"]) == (0.5, 0.5) and got["production"]["execution_accuracy_given_valid"] == 0.5
    assert evaluate.oracle_report(df.limit(0), "id").count() == 0


def test_round_robin_by_turns(spark):
    sizes = {("s0", "a"): 1, ("s0", "b"): 4, ("s1", "a"): 4, (None, "a"): 7}
    rows = [(s, f, 100 * k + i) for k, ((s, f), n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "schema string, family string, pos int")
    whole = [r["pos"] for r in sample.round_robin(df, "schema", "family", ["pos"], 99, 1).collect()]
    assert sorted(whole) == sorted(r[2] for r in rows)
    for total in (0, 1, 3, 4, 5, 10, 13, 15, 16):
        assert [r["pos"] for r in sample.round_robin(df, "schema", "family", ["pos"], total, 1).collect()] == whole[:total]
    assert sample.round_robin(df.limit(0), "schema", "family", ["pos"], 3, 1).count() == 0


DDL = "CREATE TABLE customers (customer_id INTEGER PRIMARY KEY, name TEXT, city TEXT); CREATE TABLE orders (order_id INTEGER PRIMARY KEY, customer_id INTEGER REFERENCES customers(customer_id), total REAL, status TEXT);"


@pytest.mark.parametrize("question, expected", [
    ("Show the name of customers in Boston", "T customers | S customers.name | F AND customers.city = 'Boston'"), ("How many orders have status 'paid'?", "T orders | A COUNT * 0 | F AND orders.status = 'paid'"),
    ("What is the average total of orders per status?", "T orders | S orders.status | A AVG orders.total 1 | G orders.status"), ("List distinct city of customers", "T customers | S customers.city | D"),
    ("Show names of customers where city is Boston or Denver", "T customers | S customers.name | F OR customers.city = 'Boston' & customers.city = 'Denver'"),
    ("show customer orders with total above 100", "T orders | S orders.* | J customers orders.customer_id customers.customer_id | F AND orders.total > 100"), ("Top 5 orders by total", "T orders | S * | O orders.total DESC | L 5"), ("customers named John", "T customers | S * | F AND customers.name = 'John'"),
])
def test_questions(question, expected):
    assert encode(question_plan(parse_ddl(DDL), question)) == expected


def test_table_hints_in_key_mentions():
    c = parse_ddl(DDL)
    assert ground(c, "List order ids with status 'paid'").canonical() == "List table2 column4 with column6 value1"
    # a shared key goes to the table that its noun names, first of all where it is the primary key
    assert ground(c, "customer_id of orders").canonical() == "table1 column1 of table2"
    assert ground(c, "total of orders").canonical() == "column5 of table2"
    bare = parse_ddl("CREATE TABLE a (id INTEGER PRIMARY KEY, v TEXT)")
    assert ground(bare, "id and v").canonical() == "column1 and column2"


def test_grounding_rules():
    c = parse_ddl(DDL)
    g = ground(c, "orders with status 'paid' and total above 7")
    assert g.canonical() == "table2 with column6 value1 and column5 above value2" and g.bindings() == {"value1": "paid", "value2": 7}
    plan = LogicalQuery("orders", ("total",), predicates=(Predicate("status", "=", "paid"),))
    there = plan_to_slots(c, plan, ["paid"])
    assert encode(there) == "T table2 | S column5 | F AND column6 = value1" and plan_from_slots(c, there, {"value1": "paid"}) == plan
    assert schema_of_slots(c).startswith("CREATE TABLE table1 (column1 INTEGER PRIMARY KEY")
    assert drop_unmentioned(plan, "orders that are open").predicates == ()
    wrong = LogicalQuery("customers", ("name",), predicates=(Predicate("status", "=", "Boston"),))
    assert repair_location(c, wrong, "customers in Boston").predicates[0].column == "customers.city" and repair_location(c, wrong, "customers like Boston") == wrong
    assert combine("prefer", plan, None) == plan and combine("confidence", plan, wrong, 0.2) == plan and combine("replace", plan, None) is None
    assert substitute_roles(c, decode("T orders | S total"), {"column0": "status"}).columns == ("orders.status",)
    assert assemble(c, {"operators": [">"]}, {"table": ["orders"], "columns": ["total"], "filters": ["total"]}, ["12.5"]).predicates[0].value == 12.5 and assemble(c, {}, {"table": ["ghosts"], "columns": ["x"]}, []) is None
    assert only_known_names(c, "SELECT name FROM customers WHERE city = 'ghost'") and not only_known_names(c, "SELECT ghost FROM customers")
    assert legend(c, "orders by status").startswith("table2=orders")
    with pytest.raises(AnalysisError):
        question_plan(c, "Show all invoices")


def test_generated_corpora(spark):
    a = generate.records_for(3, 1, 24)
    assert a == generate.records_for(3, 1, 24) and len(a) == 24 and len({r["question"] for r in a}) == 24
    assert all(evaluate.execute(r["database_sql"], r["sql"]) for r in a)
    catalog, roles = generate.make_schema(3, 1)
    rows = generate.populate(catalog, roles, 3)
    assert len(rows[roles["parent"]]) == 12 and len(rows[roles["child"]]) == 32 and len(generate.cross_product(roles, 50.0, "open")) == 48
    plans = generate.compose(roles, rows, 30, 1)
    assert len({generate.plan_key(p) for p in plans}) == 30 and not any(map(generate.held_out, plans)) and all(map(generate.held_out, generate.compose(roles, rows, 5, 1, reserved=True)))
    assert {r["counterfactual_change"] for r in generate.contrast_corpus(3, 1)} <= {"operator", "aggregate", "direction", "value", "connector"}
    x, _ = generate.opaque_schema(3, 1)
    assert all(t.name.startswith("x_") for t in x.tables)
    df = generate.corpus(spark, 4, 8, 9)
    assert df.count() == 32 and df.select("schema_id").distinct().count() == 4
    assert generate.novel_marker([{"a": 1}], [1, 2]) == 2 and generate.threshold([1, 2, 2, 3]) == 2 and generate.explicit_rate("the total", decode("T t | S total,x")) == 0.5
    good = 0
    for r in a:
        try:
            good += evaluate.equivalent(evaluate.execute(r["database_sql"], render(question_plan(parse_ddl(r["schema_sql"]), r["question"]))), evaluate.execute(r["database_sql"], r["sql"]), False)
        except Rejected:
            pass
    assert good >= len(a) * 0.7


def test_builders(spark):
    from planloom.operators import builders

    corpus = generate.corpus(spark, 6, 10, 4).withColumn("pos", F.row_number().over(__import__("pyspark").sql.Window.orderBy("id")).cast("long"))
    own, other = corpus.where("pos <= 30"), corpus.where("pos > 30")
    frozen = own.where("pos <= 5")
    built = builders.curriculum({"a": own, "b": other}, {"a": 1, "b": 3}, 24, frozen, 2)
    assert {r["mix_source"]: r["n"] for r in built.report["sources"].collect()} == {"a": 6, "b": 18} and built.report["duplicates"].first()["duplicates"] == 0
    assert sum(r["n"] for r in built.log.collect()) >= 5
    wrong = own.limit(3).withColumn("sql", F.lit("SELECT 1")).withColumn("pos", F.col("pos") + 1000)
    mixed = builders.replay(own, other.unionByName(wrong), 2, 1)
    assert mixed.records.count() == 90 and mixed.log.first()["n"] == 3 and mixed.report["conflicts"].isEmpty()
    gate = builders.gate(spark, "casual", 3, 5, 77, corpus)
    assert gate.count() == 15 and gate.first()["evaluation_track"] == "casual"
    pairs = builders.contrast_gate(spark, 3, 5)
    assert all(r["count"] == 2 for r in pairs.groupBy("counterfactual_group").count().collect())
    with pytest.raises(Rejected, match="unknown_gate"):
        builders.gate(spark, "none", 1, 1, 1)


SCRIPT = "CREATE TABLE city (name TEXT, people INTEGER); INSERT INTO city VALUES ('Ulm', 5), ('Bonn', 7), ('Status', 1);"


def test_external_statements_are_converted_and_executed(spark):
    from planloom.plans.sqlform import recover_literals

    names = ["city", "name", "people"]
    assert recover_literals('SELECT name FROM city WHERE name = "Ulm"', names) == ("SELECT name FROM city WHERE name = 'Ulm'", 1)
    assert recover_literals('SELECT "Ulm" FROM city WHERE name = "people"', names)[1] == 0
    rows = [
        ("SELECT name FROM city WHERE name = \"Ulm\"", SCRIPT), ("SELECT name FROM city WHERE people > 9", SCRIPT), ("SELECT name FROM nowhere", SCRIPT),
        ("SELECT name FROM city UNION SELECT 1", SCRIPT), ("SELECT name FROM city ORDER BY people DESC LIMIT 2", SCRIPT), ("SELECT name FROM city", "ATTACH 'x' AS y"), (None, None),
    ]
    df = spark.createDataFrame(rows, "sql string, database_sql string").withColumn("names", F.array(*map(F.lit, names)))
    got = evaluate.convert(df, names="names").collect()
    assert [r["reason"] for r in got] == [None, "empty_result", "original_execution_error", "not_one_select", None, "original_execution_error", "not_one_select"]
    assert got[0]["rewritten"] == 1 and got[0]["converted"] == "SELECT name FROM city WHERE name = 'Ulm'" and got[4]["plan"]["limit"] == 2
    assert evaluate.validate("SELECT name FROM city WHERE people = 7", SCRIPT) == (True, [("Bonn",)])
    assert evaluate.validate("SELECT name FROM city WHERE people = 8", SCRIPT)[0] is False and evaluate.validate("SELECT name FROM city WHERE people = 8", SCRIPT, require_rows=False)[0] is True
    assert evaluate.validate("DROP TABLE city", SCRIPT) == (False, [])


def test_predictions_must_stand_at_the_same_positions(spark):
    records = spark.createDataFrame([(i, "SELECT 1") for i in range(5)], "pos long, sql string")

    def told(positions):
        return spark.createDataFrame([(i, f"p{i}") for i in positions], "pos long, prediction string")

    assert sorted((r["pos"], r["prediction"]) for r in evaluate.zip_predictions(records, told(range(5))).collect()) == [(i, f"p{i}") for i in range(5)]
    for positions, reason in ((range(1, 6), "predictions_differ_in_position"), (range(4), "predictions_differ_in_number"), ([0, 1, 2, 3, 3], "predictions_differ_in_position")):
        with pytest.raises(Rejected) as caught:
            evaluate.zip_predictions(records, told(positions))
        assert caught.value.reason == reason


def test_names_and_headers():
    assert text.singular("status") == "status" and text.singular("cities") == "city"
    assert {"customers id", "customers_ids", "customer/id", "customer_ids"} <= set(text.aliases("customer_id"))
    assert text.header_identifier("Case") == "field_case" and text.header_identifier("Create") == "field_create"
    with pytest.raises(Rejected) as caught:
        text.required_number("none")
    assert caught.value.reason == "numeric_conversion_error"


def test_reserved_combinations_have_names():
    from planloom.plans.logical import LogicalQuery, Predicate, signature, tier

    two = (Predicate("a", "=", 1), Predicate("b", "=", 2))
    joined = {"join_table": "u", "join_on": ("t.x", "u.x")}
    assert generate.held_out(LogicalQuery(table="t", aggregate="COUNT", predicates=two, **joined)) == "join_count_multi_filter"
    assert generate.held_out(LogicalQuery(table="t", aggregate="MAX", aggregate_column="a", predicates=two, **joined)) == "join_aggregate_multi_filter"
    assert generate.held_out(LogicalQuery(table="t", columns=("a",), distinct=True, predicates=two[:1], limit=3)) == "distinct_filter_limit"
    assert generate.held_out(LogicalQuery(table="t", columns=("a",), aggregate="COUNT", group_by=("a",), predicates=two[:1])) == "group_filter"
    one = LogicalQuery(table="t", columns=("a",), predicates=two[:1])
    assert generate.held_out(one) is None and tier(one) == "pair" and signature(one) == "compose_single_select_filter1_and"


def test_schema_links(spark):
    tables = spark.createDataFrame([(1, None, None, 0.0), (1, "a", 1.0, 5.0), (1, "b", 2.0, 1.0), (1, "c", 0.0, 9.0), (2, None, None, 3.0), (2, "a", 0.5, 0.0), (2, "b", 0.5, 2.0)], "record int, table string, base_score double, join_score double")
    joins = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", "b")], "record int, base string, joined string")
    chosen = links.best_tables(tables, joins)
    got = {r["record"]: r for r in chosen.collect()}
    assert [tuple(got[i][c] for c in ("base", "joined", "score")) for i in (1, 2)] == [("b", "a", 7.0), ("a", None, 3.5)]
    valid = [1.0, 2.0, 0.0, 1.0 + 1.0, 2.0 + 5.0]
    assert got[1]["confidence"] == pytest.approx(1 / sum(np.exp(v - 7.0) for v in valid))
    owners = spark.createDataFrame([(i, role, t, s) for i in (1, 2) for role in ("order", "projection") for t, s in (("a", 0.0), ("b", 1.0), ("c", 50.0))], "record int, role string, owner string, score double")
    columns = spark.createDataFrame([(i, role, c, s) for i in (1, 2) for role, c, s in (("order", "x", 1.0), ("order", "y", 9.0), ("order", "z", 90.0), ("projection", "x", 1.0), ("projection", "*", 3.0))], "record int, role string, column string, score double")
    pairs = spark.createDataFrame([(i, t, c) for i in (1, 2) for t, c in (("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"))], "record int, owner string, column string")
    best = {(r["record"], r["role"]): (r["owner"], r["column"], r["score"]) for r in links.best_columns(chosen, owners, columns, pairs).collect()}
    assert best == {(1, "order"): ("a", "y", 9.0), (1, "projection"): ("b", "*", 4.0), (2, "order"): ("a", "y", 9.0), (2, "projection"): ("a", "*", 3.0)}
    assert links.best_tables(tables.limit(0), joins).count() == 0


def test_columns_named_like_inner_ones(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], str(i % 3), 7, 7, 7, 7, 7) for i in range(12)], "pos int, family string, sql string, at int, k int, own int, _k int, _nth int")
    assert curate.keep_first(df, ["family"], "pos").columns == df.columns and curate.exclude_conflicts(df, ["family"], "sql", "pos").count() == 4
    assert sample.weighted_resample(df, "family", {}, ["pos"], 12, 1).select("_nth").distinct().count() == 1
    assert sample.round_robin(df, "family", "sql", ["pos"], 6, 1).columns == df.columns
    kept, log = curate.curate(df.withColumn("_reason", F.lit("x")), F.when(F.col("pos") > 9, "late"), ["family"], "pos")
    assert kept.columns == [*df.columns, "_reason"] and {r["reason"]: r["n"] for r in log.collect()} == {"late": 2, "duplicate_schema_question": 8}
