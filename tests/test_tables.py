import pytest

from carrel.functions.text import question_terms
from carrel.operators import tables as T
from carrel.plans import planner as PL
from carrel.plans.guard import guarded_sql, planned_sql_is_safe


@pytest.fixture(scope="module")
def cohort(spark):
    return spark.createDataFrame([("S1", "F", 20.0), ("S1", "M", 25.0), ("S2", "F", 30.0), ("S3", None, None)], "Subject string, Sex string, BMI double")


def test_statistics(cohort):
    assert T.table_stat(cohort, "bmi", "average").first().asDict() == {"value": 25.0, "row_count": 4, "non_null": 3}
    assert T.table_stat(cohort, "BMI", "mean", where="BMI >= 25").first()["value"] == 27.5
    assert T.table_stat(cohort, "Subject", "unique").first()["value"] == 3
    assert T.table_stat(cohort, "BMI", "missing").first()["value"] == 1
    assert [tuple(r) for r in T.table_stat(cohort, "BMI", "max", group_by="Sex").collect()] == [("F", 30.0), ("M", 25.0), (None, None)]


def test_errors(cohort):
    with pytest.raises(ValueError):
        T.table_stat(cohort, "nope", "mean")
    with pytest.raises(ValueError):
        T.table_stat(cohort, "BMI", "mode")
    with pytest.raises(ValueError):
        T.table_stat(cohort, "BMI", "mean", where="no such column > 1")


def test_empty_and_values(cohort):
    assert T.table_stat(cohort.limit(0), "BMI", "mean").first()["value"] is None
    assert [tuple(r) for r in T.distinct_values(cohort, "Subject").collect()] == [("S1", 2), ("S2", 1), ("S3", 1)]
    schema = {r["column"]: r for r in T.table_schema(cohort).collect()}
    assert schema["BMI"]["missing"] == 1 and schema["Sex"]["uniques"] == 2
    assert T.search_rows(cohort, "subject s2", "c", "Subject").first()["row_key"] == "S2"


def test_guard(spark, cohort):
    assert guarded_sql(spark, "select count(*) as n from c", {"c": cohort}).first()["n"] == 4
    for bad in ("drop table c", "insert into c values (1)", "select 1; select 2", ""):
        with pytest.raises(ValueError):
            guarded_sql(spark, bad, {"c": cohort})
    assert planned_sql_is_safe("select created_at from _table") and not planned_sql_is_safe("select 1 from x")


@pytest.mark.parametrize(
    "question, intent, column",
    [("what is the average BMI?", "aggregate", "BMI"), ("how many rows are there?", "count_rows", ""), ("how many distinct Subject", "count_distinct", "Subject"), ("breakdown of Sex", "count_values", "Sex"), ("which columns are there", "schema", ""), ("what colums exist?", "schema", "")],
)
def test_plans(cohort, question, intent, column):
    plan = PL.plan_question(question, "cohort", cohort)
    assert (plan.intent, plan.column) == (intent, column)


def test_session(spark, cohort):
    s = PL.QuerySession(spark)
    assert s.add_table("cohort", cohort) == "cohort" and s.add_table("cohort", cohort) == "cohort (2)"
    a = s.ask("what is the average BMI?")
    assert a.value == 25.0 and a.answer.endswith("is 25.") and a.computed
    assert s.ask("and what about the maximum?").value == 30.0
    s.close()
    with pytest.raises(ValueError):
        s.ask("x")


def test_terms():
    assert question_terms("the lesions")[:2] == ["lesion", "nodule"]


def test_guard(spark):
    from carrel.plans.guard import guarded_sql

    t = {"a": spark.range(5).toDF("x"), "b": spark.range(3).toDF("x")}
    good = ["WITH t AS (SELECT x FROM a), u AS (SELECT * FROM t) SELECT * FROM u JOIN b USING (x)", "SELECT x FROM a WHERE x IN (SELECT x FROM b)", "SELECT x, (SELECT max(x) FROM b) AS m FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.x = a.x)", "SELECT x FROM a EXCEPT SELECT x FROM b", "SELECT * FROM a LATERAL VIEW explode(array(1, 2)) t AS e"]
    for sql in good:
        assert guarded_sql(spark, sql, t).count() >= 2, sql
    bad = ["WITH t AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM t", "SELECT * FROM text.`/etc/hostname`", "WITH t AS (SELECT * FROM csv.`/etc/hosts`) SELECT * FROM t", "SELECT * FROM a WHERE x IN (SELECT x FROM text.`/etc/hostname`)", "SELECT * FROM other", "SELECT * FROM range(5)",
           "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "WITH u AS (SELECT * FROM v), v AS (SELECT 1) SELECT * FROM u", "DROP TABLE a", "SELECT 1; SELECT 2", "", "SET x = 1"]
    for sql in bad:
        with pytest.raises(ValueError):
            guarded_sql(spark, sql, t)
    assert not spark.catalog.listTables()


def test_plans_of_counts(spark):
    df = spark.createDataFrame([(f"S{i}", "M" if i % 2 else "F", float(i)) for i in range(30)], "subject_id string, sex string, bmi double")
    s = PL.QuerySession(spark)
    s.add_table("cohort", df)
    assert s.ask("how many subjects are there?").value == 30 and s.ask("how many subjects are there?").plan.column == "subject_id"
    assert s.ask("how many rows are there?").plan.intent == "count_rows"
    assert s.ask("breakdown of sex").answer == "sex distribution: F (15), M (15)."
    assert s.ask("how many are there?").plan.intent in ("count_values", "count_distinct")
    refused = s.ask("what is the average price of gold?")
    assert refused.code == "missing_computed_evidence" and refused.confidence == 0.0 and len(refused.payload()) == 29
    # what the evidence states is what is answered
    answer, evidence = s.ask_sql("breakdown of sex", "SELECT sex, count(*) AS n FROM _table GROUP BY sex ORDER BY sex", "cohort")
    assert answer == "sex distribution (2 groups): F=15, M=15." and [e.evidence_type for e in evidence] == ["table_sql", "table_value", "table_value", "table_stat"]
    with pytest.raises(ValueError):
        s.ask_sql("x", "SELECT * FROM cohort", "cohort")


def test_unique_names_and_terms(spark):
    from carrel.operators.search import term_frequencies
    from carrel.sources.readers import unique_names

    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2), (None, 9), (None, 10)], "name string, k int")
    got = {(r.name, r.k, r.unique_name) for r in unique_names(df, "name", "k").collect()}
    assert got == {("a", 1, "a"), ("a", 2, "a (2)"), ("a", 3, "a (3)"), ("b", 2, "b"), (None, 9, None), (None, 10, None)}
    terms = {(r.term, r.n, r.docs) for r in term_frequencies(spark.createDataFrame([("Cats cat dog",), ("cat",), (None,), ("",)], "t string"), "t").collect()}
    assert terms == {("cat", 3, 2), ("dog", 1, 1)}


def test_exact_quantiles(spark):
    import random

    r = random.Random(4)
    for values in ([], [None], [3.0], [1.0, 2.0], [5.0] * 40 + [r.random() * 10 for _ in range(60)], [float(i % 7) for i in range(101)] + [None, float("nan")]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        clean = sorted(v for v in values if v is not None and v == v)
        got = T.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
        if not clean:
            assert got == [None] * 5
            continue
        for q, g in zip([0.0, 0.25, 0.5, 0.75, 1.0], got):
            at = (len(clean) - 1) * q
            low, high = clean[int(at)], clean[min(len(clean) - 1, int(at) + 1)]
            assert abs(g - (low + (high - low) * (at - int(at)))) < 1e-12


def test_schema_of_any_columns(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (1, 0.0, None), (2, -0.0, [1, 2]), (None, float("nan"), [])], "a int, b double, c array<int>")
    rows = {r["column"]: r for r in T.table_schema(df).collect()}
    assert [(rows[c]["non_null"], rows[c]["missing"], rows[c]["uniques"]) for c in "abc"] == [(3, 1, 2), (2, 2, 1), (3, 1, 2)]
    empty = T.table_schema(df.limit(0)).collect()
    assert [(r["column"], r["non_null"], r["missing_pct"]) for r in empty] == [("a", 0, 0.0), ("b", 0, 0.0), ("c", 0, 0.0)]


def test_shared_folder(spark):
    from carrel import session

    assert session.shared_folder(spark)

    class Elsewhere:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)
    Elsewhere.conf = {"spark.checkpoint.dir": "hdfs://shared"}
    assert session.shared_folder(Elsewhere) == "hdfs://shared"
