"""Corpus and evaluation operators applied to the test tables, with their SQL.

Records are documents: the family is the language, the group the source, the position
the id.  Scored rows are derived from documents and labels by rules that any
engine can compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.text import folded, identifiers
from planloom.operators import curate, evaluate, report, sample
from planloom.plans import library as plans
from planloom.plans.logical import PLAN_STRUCT, family, linking_family, signature, tier, to_struct

Query = Callable[[SparkSession, str], DataFrame]
SEED = 7


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", "lang", "source", "n_chars")


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.pmod("doc_id", F.lit(10)) < 8, "train").when(F.pmod("doc_id", F.lit(10)) == 8, "validation").otherwise("test")
    return _docs(spark, sf).withColumn("split", split)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """A rule predicts quality from length; validity, tracks, pairs and groups come from columns."""
    docs = _docs(spark, sf).select("doc_id", "lang", "source", "n_chars").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    valid = (F.col("n_chars") >= 200).cast("int")
    runs = (F.col("n_chars").between(200, 6000)).cast("int")
    right = ((F.col("quality") == 1) & (runs == 1)).cast("int")
    rows = docs.select("doc_id", "lang", "source", "toxic", valid.alias("syntactically_valid"), runs.alias("executable"), (right * (1 - F.col("toxic"))).cast("int").alias("exact_match"), right.alias("execution_accuracy"))
    failure = F.when(F.col("syntactically_valid") == 0, evaluate.FAILURES[0]).when(F.col("executable") == 0, evaluate.FAILURES[1]).when(F.col("execution_accuracy") == 0, evaluate.FAILURES[2]).otherwise(evaluate.FAILURES[3])
    track = F.when(F.pmod("doc_id", F.lit(2)) == 0, "direct_identifier").otherwise("semantic_paraphrase")
    half = F.floor(F.col("doc_id") / 2).cast("long")
    return rows.withColumns({"failure": failure, "track": track, "pair": half, "group": half, "change": F.col("lang")})


_SCORED = """
WITH scored AS (
  SELECT doc_id, lang, source, toxic, syntactically_valid, executable, execution_accuracy, execution_accuracy * (1 - toxic) AS exact_match,
         CASE WHEN syntactically_valid = 0 THEN 'unsafe_or_incomplete_output' WHEN executable = 0 THEN 'execution_error' WHEN execution_accuracy = 0 THEN 'wrong_result' ELSE 'correct_execution' END AS failure,
         CASE WHEN doc_id % 2 = 0 THEN 'direct_identifier' ELSE 'semantic_paraphrase' END AS track, doc_id // 2 AS pair, lang AS change
  FROM (SELECT d.doc_id, lang, source, toxic, CAST(n_chars >= 200 AS INT) AS syntactically_valid, CAST(n_chars BETWEEN 200 AND 6000 AS INT) AS executable,
               CAST(quality = 1 AND n_chars BETWEEN 200 AND 6000 AS INT) AS execution_accuracy
        FROM documents d JOIN labels USING (doc_id))
)
"""
_MEANS = "avg(syntactically_valid) AS syntactically_valid, avg(executable) AS executable, avg(exact_match) AS exact_match, avg(execution_accuracy) AS execution_accuracy"
_FOLDED = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_KEY = f"md5('{SEED}:' || CAST(doc_id AS VARCHAR))"
_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END"


def dedupe_keep_first(spark, sf):
    return curate.keep_first(_docs(spark, sf), [folded("text")], "doc_id").select("doc_id", "lang", "source")


def duplicate_count(spark, sf):
    return curate.duplicate_count(_docs(spark, sf), [folded("text")])


def conflict_audit(spark, sf):
    return curate.conflict_audit(_docs(spark, sf).withColumn("key", F.md5(folded("text"))), ["key"], "source")


def conflict_exclude(spark, sf):
    return curate.exclude_conflicts(_docs(spark, sf), [folded("text")], "source", "doc_id").select("doc_id", "source")


def curate_log(spark, sf):
    docs = _docs(spark, sf)
    reason = F.when(F.col("n_chars") < 100, "too_short").when(F.col("n_chars") > 5000, "sequence_too_long")
    return curate.curate(docs, reason, [folded("text")], "doc_id")[1]


def decontaminate_exact(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").select("text")
    return curate.remove_matching(_docs(spark, sf), benchmark, [folded("text")]).select("doc_id")


def contamination_matches(spark, sf):
    splits = _splits(spark, sf)
    columns = {"schema": F.col("source"), "question": folded("text"), "sql": F.col("lang")}
    found = curate.contamination(splits.where("split = 'train'"), splits.where("split = 'test'"), columns)
    return found.where("size(matches) > 0").select("doc_id", F.array_join("matches", ",").alias("matches"))


def overlap_counts(spark, sf):
    splits = _splits(spark, sf)
    return curate.overlap_counts(splits.where("split = 'train'"), splits.where("split = 'test'"), {"schema": F.col("source"), "question": folded("text")})


def split_by_group(spark, sf):
    rows = sample.split_groups(_records(spark, sf), "source", SEED)
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


def isolation_check(spark, sf):
    return curate.overlapping(sample.split_groups(_records(spark, sf), "source", SEED), "split", "source")


def quota_by_family(spark, sf):
    return sample.quotas(_records(spark, sf), "lang", 101).select("lang", "n", "quota")


def balanced_take(spark, sf):
    return sample.balanced_take(_records(spark, sf).withColumn("block", F.floor(F.col("doc_id") / 4)), "lang", "block", ["doc_id"], 60, SEED).select("doc_id", "lang", "block")


def stratified_round_robin(spark, sf):
    return sample.round_robin(_records(spark, sf), "source", "lang", ["doc_id"], 50, SEED).select("doc_id", "source", "lang")


def exact_sample(spark, sf):
    return sample.exact_sample(_records(spark, sf), 100, ["doc_id"], SEED).select("doc_id")


def cycle_sample(spark, sf):
    few = _records(spark, sf).where("lang = 'es'")
    return sample.cycle_sample(few, 250, ["doc_id"], SEED).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))


def weighted_resample(spark, sf):
    return sample.weighted_resample(_records(spark, sf), "lang", {"es": 4.0, "en": 0.5}, ["doc_id"], 900, SEED).select("doc_id", "lang", "cycle")


def mix_fraction(spark, sf):
    rows = _records(spark, sf)
    return sample.mix_fraction(rows.where("lang = 'de'"), rows.where("lang = 'en'"), 0.25, ["doc_id"], SEED - 1).select("doc_id", "lang", "mix_source")


def mix_sources(spark, sf):
    rows = _records(spark, sf)
    parts = {lang: rows.where(F.col("lang") == lang) for lang in ("en", "fr")}
    return sample.mix_sources(parts, {"en": 2, "fr": 1}, 100, ["doc_id"], SEED, "doc_id").select("doc_id", "mix_source")


def quality_report_split(spark, sf):
    return report.split_report(_splits(spark, sf), "split", [folded("text")], "lang")


def overlap_matrix(spark, sf):
    return report.overlap_matrix(_splits(spark, sf), "split", F.md5(folded("text")))


def family_counts(spark, sf):
    return report.counts(_splits(spark, sf), "split", "lang")


def novelty_rate(spark, sf):
    splits = _splits(spark, sf)
    return report.novelty(splits.where("split = 'test'"), splits.where("split = 'train'"), identifiers("text"))


def token_overlap(spark, sf):
    pairs = _docs(spark, sf)
    return report.mean_overlap(pairs.withColumn("head", F.concat_ws(" ", "source", "lang", "text")), "text", "head", "lang")


def length_audit(spark, sf):
    docs = _docs(spark, sf)
    return report.length_audit(docs, "n_chars", 5000, F.col("text").endswith("."))


def plan_classify(spark, sf):
    """The plan library as a table of structs, classified by column functions."""
    rows = [(key, to_struct(plans.plan(key))) for key in plans.PLANS]
    df = spark.createDataFrame(rows, f"key string, plan {PLAN_STRUCT}")
    return df.select("key", report.family_of("plan").alias("family"), report.linking_family_of("plan").alias("linking_family"), report.signature_of("plan").alias("signature"), report.tier_of("plan").alias("tier"))


def operation_match(spark, sf):
    """Every plan of the library against every other one, by columns."""
    rows = [(key, to_struct(plans.plan(key))) for key in plans.PLANS]
    own = spark.createDataFrame(rows, f"key string, plan {PLAN_STRUCT}")
    pairs = own.join(own.toDF("gold_key", "gold"), F.col("key") != F.col("gold_key"))
    return pairs.select("key", "gold_key", evaluate.operation_match("plan", "gold").alias("o")).select("key", "gold_key", "o.*")


def eval_overall(spark, sf):
    return evaluate.overall(_scored(spark, sf))


def eval_by_family(spark, sf):
    return evaluate.by_fields(_scored(spark, sf), ["lang", "source"])


def eval_by_track(spark, sf):
    return evaluate.by_fields(_scored(spark, sf).withColumn("slice", evaluate.track_slice("track", "lang")), ["track", "slice"])


def eval_failures(spark, sf):
    return evaluate.failure_counts(_scored(spark, sf))


def eval_pairs(spark, sf):
    return evaluate.paired_tracks(_scored(spark, sf), "pair", "track")


def eval_counterfactual(spark, sf):
    return evaluate.counterfactual(_scored(spark, sf), "group", "change")


def eval_rescue(spark, sf):
    return evaluate.rescue_ceiling(_scored(spark, sf), "exact_match", "execution_accuracy")


def bag_diff(spark, sf):
    splits = _splits(spark, sf)
    return evaluate.bag_difference(splits.where("split = 'test'").select("source", "lang"), splits.where("split = 'validation'").select("source", "lang"))


def threshold_probe(spark, sf):
    """The middle one of the distinct values that a join reaches."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    customer = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'")
    values = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_totalprice").distinct()
    return values.agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", 0.5).alias("middle"))


ORACLES = {
    "dedupe_keep_first": f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY {_FOLDED} ORDER BY doc_id) = 1",
    "duplicate_count": f"SELECT count(*) AS rows, count(DISTINCT {_FOLDED}) AS distinct_keys, count(*) - count(DISTINCT {_FOLDED}) AS duplicates FROM documents",
    "conflict_audit": f"SELECT md5({_FOLDED}) AS key, count(DISTINCT source) AS n_values FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "conflict_exclude": f"SELECT doc_id, source FROM documents QUALIFY source = first_value(source) OVER (PARTITION BY {_FOLDED} ORDER BY doc_id)",
    "curate_log": f"""WITH r AS (SELECT *, CASE WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 5000 THEN 'sequence_too_long' END AS reason FROM documents)
        SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'duplicate_schema_question', count(*) - count(DISTINCT {_FOLDED}) FROM r WHERE reason IS NULL HAVING count(*) > count(DISTINCT {_FOLDED})""",
    "decontaminate_exact": f"SELECT doc_id FROM documents WHERE {_FOLDED} NOT IN (SELECT {_FOLDED} FROM benchmark)",
    "contamination_matches": f"""WITH s AS (SELECT *, {_SPLIT} AS split, {_FOLDED} AS q FROM documents), t AS (SELECT * FROM s WHERE split = 'test'),
        m AS (SELECT doc_id, list_filter([CASE WHEN (q, lang) IN (SELECT (q, lang) FROM t) THEN 'question_sql' END, CASE WHEN (source, q) IN (SELECT (source, q) FROM t) THEN 'schema_question' END, CASE WHEN (source, lang) IN (SELECT (source, lang) FROM t) THEN 'schema_sql' END], lambda x: x IS NOT NULL) AS m FROM s WHERE split = 'train')
        SELECT doc_id, array_to_string(m, ',') AS matches FROM m WHERE len(m) > 0""",
    "overlap_counts": f"""WITH s AS (SELECT *, {_SPLIT} AS split, {_FOLDED} AS q FROM documents), t AS (SELECT * FROM s WHERE split = 'test'), a AS (SELECT * FROM s WHERE split = 'train')
        SELECT 'schema' AS key, count(*) AS n FROM a WHERE source IN (SELECT source FROM t) UNION ALL SELECT 'question', count(*) FROM a WHERE q IN (SELECT q FROM t)
        UNION ALL SELECT 'schema_question', count(*) FROM a WHERE (source, q) IN (SELECT (source, q) FROM t)""",
    "split_by_group": f"""WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('{SEED}:' || source), source) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)),
        s AS (SELECT source, CASE WHEN r <= k - 2 * greatest(CASE WHEN k >= 3 THEN 1 ELSE 0 END, k // 10) THEN 'train' WHEN r <= k - greatest(CASE WHEN k >= 3 THEN 1 ELSE 0 END, k // 10) THEN 'validation' ELSE 'test' END AS split FROM g)
        SELECT split, source, count(*) AS n FROM documents JOIN s USING (source) GROUP BY ALL""",
    "isolation_check": "SELECT source, 0::BIGINT AS n_splits FROM documents WHERE false",
    "quota_by_family": """WITH c AS (SELECT lang, count(*) AS n, count(*) OVER () AS k FROM documents GROUP BY lang)
        SELECT lang, n, CAST(101 // k + CASE WHEN row_number() OVER (ORDER BY lang) <= 101 % k THEN 1 ELSE 0 END AS BIGINT) AS quota FROM c""",
    "balanced_take": f"""WITH one AS (SELECT doc_id, lang, doc_id // 4 AS block FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 4 ORDER BY {_KEY}, doc_id) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) AS nth FROM one),
        q AS (SELECT lang, 60 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY lang) <= 60 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT lang FROM one)),
        j AS (SELECT r.*, nth <= quota AS chosen FROM r JOIN q USING (lang)),
        f AS (SELECT doc_id, lang, block, row_number() OVER (ORDER BY md5('{SEED + 1}:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM j WHERE NOT chosen)
        SELECT doc_id, lang, block FROM j WHERE chosen UNION ALL SELECT doc_id, lang, block FROM f WHERE k <= 60 - (SELECT count(*) FROM j WHERE chosen)""",
    "stratified_round_robin": f"""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {_KEY}, doc_id) AS nth FROM documents),
        p AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || lang), lang) AS place FROM (SELECT DISTINCT source, lang FROM documents))
        SELECT doc_id, source, lang FROM r JOIN p USING (source, lang) ORDER BY nth, place, source, doc_id LIMIT 50""",
    "exact_sample": f"SELECT doc_id FROM documents ORDER BY {_KEY}, doc_id LIMIT 100",
    "cycle_sample": "WITH n AS (SELECT count(*) AS n FROM documents WHERE lang = 'es'), c AS (SELECT unnest(range(0, CAST(250 // n + 1 AS BIGINT))) AS cycle, n FROM n) SELECT CAST(cycle AS INT) AS cycle, CASE WHEN cycle < 250 // n THEN n ELSE 250 % n END AS n FROM c WHERE cycle < 250 // n OR 250 % n > 0",
    "weighted_resample": f"""WITH c AS (SELECT lang, count(*) AS n, count(*) * CASE lang WHEN 'es' THEN 4.0::DOUBLE WHEN 'en' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY lang),
        s AS (SELECT lang, n, w * 900 / sum(w) OVER () AS share FROM c),
        q AS (SELECT lang, n, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) <= 900 - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM s),
        r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) AS nth FROM documents)
        SELECT doc_id, lang, CAST(unnest(range(0, CAST(floor((quota - nth) / n) AS BIGINT) + 1)) AS INT) AS cycle FROM r JOIN q USING (lang) WHERE nth <= quota""",
    "mix_fraction": f"""WITH own AS (SELECT doc_id, lang FROM documents WHERE lang = 'de'), ext AS (SELECT doc_id, lang FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (ORDER BY {_KEY}, doc_id) <= (SELECT round_even(count(*) * 0.25::DOUBLE / 0.75::DOUBLE, 0) FROM own))
        SELECT doc_id, lang, 'own' AS mix_source FROM own UNION ALL SELECT doc_id, lang, 'external' FROM ext""",
    "mix_sources": f"""SELECT 'en:' || doc_id AS doc_id, 'en' AS mix_source FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY {_KEY}, doc_id LIMIT 67)
        UNION ALL SELECT 'fr:' || doc_id, 'fr' FROM (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY md5('{SEED + 1}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 33)""",
    "quality_report_split": f"SELECT {_SPLIT} AS split, count(*) AS rows, count(DISTINCT {_FOLDED}) AS distinct_keys, count(*) - count(DISTINCT {_FOLDED}) AS duplicates, count(DISTINCT lang) AS families FROM documents GROUP BY 1",
    "overlap_matrix": f"""WITH s AS (SELECT DISTINCT {_SPLIT} AS split, md5({_FOLDED}) AS k FROM documents)
        SELECT a.split AS left_split, b.split AS right_split, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.split < b.split GROUP BY ALL""",
    "family_counts": f"SELECT {_SPLIT} AS split, lang, count(*) AS n FROM documents GROUP BY ALL",
    "novelty_rate": f"""WITH t AS (SELECT DISTINCT {_SPLIT} AS split, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS t FROM documents), w AS (SELECT * FROM t WHERE t NOT IN ('create', 'table', 'integer', 'real', 'text', 'primary', 'key', 'references')),
        o AS (SELECT t FROM w WHERE split = 'test'), m AS (SELECT count(*) AS tokens, count(*) FILTER (t NOT IN (SELECT t FROM w WHERE split = 'train')) AS novel FROM o)
        SELECT tokens, novel, novel / greatest(tokens, 1) AS rate FROM m""",
    "token_overlap": """WITH w AS (SELECT lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS l, list_distinct(regexp_extract_all(lower(concat_ws(' ', source, lang, text)), '[a-z0-9]+')) AS r FROM documents)
        SELECT lang, round(avg(len(list_intersect(l, r)) / len(r)), 9) AS overlap, count(*) AS n FROM w WHERE len(r) > 0 GROUP BY lang""",
    "length_audit": """SELECT count(*) AS rows, count(*) FILTER (text LIKE '%.' AND n_chars <= 5000 AND n_chars > 0) AS complete, count(*) FILTER (NOT text LIKE '%.' AND n_chars <= 5000 AND n_chars > 0) AS partial,
        count(*) FILTER (n_chars = 0) AS zero, count(*) FILTER (n_chars > 5000) AS over_limit, max(n_chars) AS longest FROM documents""",
    "eval_overall": _SCORED + f"SELECT count(*) AS records, {_MEANS}, sum(execution_accuracy) / greatest(sum(syntactically_valid), 1) AS execution_accuracy_given_valid FROM scored",
    "eval_by_family": _SCORED + f"SELECT 'lang' AS field, lang AS value, count(*) AS examples, {_MEANS} FROM scored GROUP BY lang UNION ALL SELECT 'source', source, count(*), {_MEANS} FROM scored GROUP BY source",
    "eval_by_track": _SCORED + f"SELECT 'track' AS field, track AS value, count(*) AS examples, {_MEANS} FROM scored GROUP BY track UNION ALL SELECT 'slice', track || ':' || lang, count(*), {_MEANS} FROM scored GROUP BY track, lang",
    "eval_failures": _SCORED + "SELECT f.failure, count(s.doc_id) AS n, count(s.doc_id) / greatest((SELECT count(*) FROM scored), 1) AS rate FROM (VALUES ('unsafe_or_incomplete_output'), ('execution_error'), ('wrong_result'), ('correct_execution')) f(failure) LEFT JOIN scored s USING (failure) GROUP BY f.failure",
    "eval_pairs": _SCORED + """, p AS (SELECT pair, max(execution_accuracy) FILTER (track = 'direct_identifier') AS d, max(execution_accuracy) FILTER (track = 'semantic_paraphrase') AS p, max(exact_match) FILTER (track = 'direct_identifier') AS de, max(exact_match) FILTER (track = 'semantic_paraphrase') AS pe FROM scored GROUP BY pair)
        SELECT count(*) AS pairs, coalesce(sum(d), 0) / greatest(count(*), 1) AS direct_accuracy, coalesce(sum(p), 0) / greatest(count(*), 1) AS paraphrase_accuracy, coalesce(sum(d * p), 0) / greatest(count(*), 1) AS both_accuracy,
        coalesce(sum(d * p), 0) / greatest(coalesce(sum(d), 0), 1) AS retention, coalesce(sum((1 - d) * p), 0) / greatest(count(*) - coalesce(sum(d), 0), 1) AS rescue,
        coalesce(sum(de), 0) / greatest(count(*), 1) AS direct_exact_match, coalesce(sum(pe), 0) / greatest(count(*), 1) AS paraphrase_exact_match, coalesce(sum(de * pe), 0) / greatest(count(*), 1) AS both_exact_match FROM p WHERE d IS NOT NULL AND p IS NOT NULL""",
    "eval_counterfactual": _SCORED + ", g AS (SELECT pair, count(*) AS n, min(execution_accuracy) AS a, max(change) AS change FROM scored GROUP BY pair) SELECT change, count(*) AS groups, avg(CAST(n = 2 AND a = 1 AS INT)) AS accuracy FROM g GROUP BY change",
    "eval_rescue": _SCORED + "SELECT avg(exact_match) AS own_accuracy, avg(greatest(exact_match, execution_accuracy)) AS ceiling, count(*) FILTER (execution_accuracy > exact_match) AS rescued FROM scored",
    "bag_diff": f"""WITH s AS (SELECT source, lang, {_SPLIT} AS split FROM documents), d AS (SELECT source, lang, sum(CASE split WHEN 'test' THEN 1 ELSE -1 END) AS n FROM s WHERE split <> 'train' GROUP BY ALL)
        SELECT source, lang, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(n) AS BIGINT) AS n FROM d WHERE n <> 0""",
    "threshold_probe": "SELECT count(*) AS n, quantile_cont(o_totalprice, 0.5) AS middle FROM (SELECT DISTINCT o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')",
}


def _plan_rows() -> str:
    """The classifications by the functions on one plan, against those on a column."""
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in (k, family(p), linking_family(p), signature(p), tier(p))) + ")" for k in plans.PLANS for p in [plans.plan(k)])
    return f"SELECT * FROM (VALUES {rows}) t(key, family, linking_family, signature, tier)"


def _operation_rows() -> str:
    """The operations by the function on two plans, against those on columns."""
    pairs = [(a, b, evaluate.operations_of(plans.plan(a), plans.plan(b))) for a in plans.PLANS for b in plans.PLANS if a != b]
    names = (*evaluate.OPERATIONS, "all_operations")
    rows = ", ".join(f"('{a}', '{b}', " + ", ".join(str(o[c]) for c in names) + ")" for a, b, o in pairs)
    return f"SELECT * FROM (VALUES {rows}) t(key, gold_key, " + ", ".join(f'"{c}"' for c in names) + ")"


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in [*ORACLES, "plan_classify", "operation_match"]}


def oracles() -> dict[str, str]:
    return ORACLES | {"plan_classify": _plan_rows(), "operation_match": _operation_rows()}
