import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from carrel.functions import quality as Q
from carrel.functions.text import chunks
from carrel.operators import extract as E
from carrel.operators import phi as P
from carrel.operators import provenance as G
from carrel.operators import schemas as SC
from carrel.operators import search as S
from carrel.operators import sections as SE
from carrel.operators import verify as V
from carrel.sources import readers as R
from carrel.sources import writers as W
from carrel.streaming import batch as B


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first()["x"]


def test_phi_spans_and_redaction(spark):
    text = "SSN 123-45-6789, call (555) 123-4567 or ann@x.org on 03.Mär.2024; MRN: 12345678."
    spans = one(spark, text, lambda t: P.merge_spans(P.all_spans(t)))
    assert [(s["kind"], s["value"]) for s in spans] == [("SSN", "123-45-6789"), ("PHONE", "(555) 123-4567"), ("EMAIL", "ann@x.org"), ("DATE", "03.Mär.2024"), ("MRN", "MRN: 12345678")]
    assert all(text[s["start"] : s["end"]] == s["value"] for s in spans)
    assert one(spark, text, lambda t: P.redact_spans(t, P.merge_spans(P.all_spans(t)))).count("[REDACTED]") == 5
    assert one(spark, "clean", P.leak_score) == 1.0 and one(spark, text, P.leak_score) == 0.0
    assert one(spark, "", lambda t: P.merge_spans(P.all_spans(t))) == [] and one(spark, None, P.scrub) is None


def test_entities(spark):
    df = spark.createDataFrame([("Ann met Bob. bob left.", ["Bob", "Bob Lee"])], "t string, v array<string>")
    assert df.select(P.redact_values(F.col("t"), F.col("v")).alias("x")).first()["x"] == "Ann met [REDACTED]. [REDACTED] left."


def test_chunks(spark):
    got = one(spark, "x" * 4000, chunks)
    assert [(c["start"], c["end"]) for c in got] == [(0, 1800), (1580, 3380), (3160, 4000)]
    assert one(spark, "", chunks) is None and len(one(spark, "short", chunks)) == 1


def test_search(spark):
    docs = spark.createDataFrame([(1, "a nodule in the liver\nnothing"), (2, "plain"), (3, None), (4, "")], "id long, text string")
    hit = S.search_documents(docs, "id", "text", "liver nodules").collect()
    assert [(h["source"], h["snippet"]) for h in hit] == [(1, "a nodule in the liver")]
    assert S.search_chunks(docs, "id", "text", "liver").first()["chunk_id"] == 0
    assert {(r["term"], r["n"], r["docs"]) for r in S.term_frequencies(docs, "text").where("term = 'nodule'").collect()} == {("nodule", 1, 1)}


def test_sections_and_labels(spark):
    docs = spark.createDataFrame([(1, "intro\nFINDINGS:\nA mass.\nIMPRESSION\nStable.\nName: Ann\nLee\nEmpty: n/a"), (2, None), (3, "")], "id long, text string")
    assert [(r["name"], r["text"].split("\n")[0]) for r in SE.sections(docs, "id", "text").orderBy("section_no").collect()] == [("document", "intro"), ("findings", "A mass."), ("impression", "Stable.")]
    assert [(r["label"], r["value"]) for r in SE.labelled_blocks(docs, "id", "text").collect() if r["label"] == "Name"] == [("Name", "Ann Lee")]
    assert SE.backfill(docs, "id", "text", ["patient_name"]).first()["value"] == "Ann Lee"


@pytest.mark.parametrize(
    "field, value, kind, valid, norm",
    [("bp", "128/82", "blood_pressure", True, "128/82"), ("exam_date", "1/1/2013", "date", True, "2013-01-01"), ("exam_date", "soon", "date", False, "soon"), ("lesion_range", "16-12 mm", "range", False, "16-12 mm"), ("x", "1-2 mm", "range", True, "1-2 mm"), ("uptake_time", "90 parsecs", "unit", False, "90 parsecs"), ("size", "4.50 cm", "unit", True, "4.5 cm"), ("age", "none", "null", False, None), ("note", "hello", "text", True, "hello")],
)
def test_semantic_checks(spark, field, value, kind, valid, norm):
    df = spark.createDataFrame([(field, value)], "f string, v string")
    got = df.select(E.semantic_check(F.col("f"), F.col("v")).alias("c")).first()["c"]
    assert (got["kind"], got["valid"], got["normalized_value"]) == (kind, valid, norm)


def test_flatten_and_paths(spark):
    payload = json.dumps({"a": [{"b": 1.0}, {"b": None}], "c": True, "d": "x"})
    flat = one(spark, payload, lambda t: E.flattened(t, "verify"))
    assert [(f["path"], f["value"]) for f in flat] == [("a[0].b", "1"), ("d", "x")]
    assert one(spark, payload, lambda t: E.json_get(t, "a[0].b")) == "1" and one(spark, "{bad", lambda t: E.flattened(t)) is None
    assert E.json_set({"a": [{"b": 1}]}, "a[0].b", 2) == {"a": [{"b": 2}]}


def test_verification(spark):
    df = spark.createDataFrame([("BP is 120/82 in the morning", "The BP was 128/82 in the morning")], "c string, s string")
    assert df.select(V.claim_check(F.col("c"), F.col("s")).alias("x")).first()["x"]["verdict"] == "partially_supported"
    assert df.select(V.value_comparison(F.col("c"), F.col("s")).alias("x")).first()["x"] == "conflict"
    rows = spark.createDataFrame([(1, "a", "12", "number", "size 128"), (1, "b", "no such thing anywhere", "string", "size 128")], "id int, path string, value string, kind string, s string")
    assert V.extraction_reports(V.field_verdicts(rows, "id", "s"), "id").first()["verdict"] == "partially_supported"


def test_provenance(spark):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, None), (1, 3, "three")], "d int, p int, t string")
    assert G.assemble_pages(pages, "d", "p", "t").first()["text"] == "one\n\n\n\nthree"
    assert [(r["start"], r["end"]) for r in G.page_offsets(pages, "d", "p", "t").orderBy("p").collect()] == [(0, 3), (5, 5), (7, 12)]
    blocks = spark.createDataFrame([(1, 1, 0, 5000, 0.0, 0.0, 1.0, 1.0), (1, 2, 5000, 9000, 0.0, 0.0, 2.0, 2.0)], "d int, page int, start long, end long, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 7, 4000, 6000), (1, 8, 9000, 9500)], "d int, s int, start long, end long")
    assert sorted((r["s"], r["page"]) for r in G.span_pages(spans, blocks, "d", "s").collect()) == [(7, 1), (7, 2)]
    assert G.fuzzy_find("the quick brown fox jumps over the lazy dog today", "brown fox jumpz over the lazy dog") == (10, 43)
    assert G.fuzzy_find("xx " * 5000, "nothing alike") is None and G.fuzzy_find("", "a") is None
    assert one(spark, "a\nBorn March 15, 1985 here\nb", lambda t: G.tight_excerpt(t, F.lit("1985-03-15")))["excerpt"] == "Born March 15, 1985 here"


def test_tight_excerpts_squash_white_space_and_forgive_misspelling(spark):
    find = lambda text, value: tuple(one(spark, text, lambda t: G.tight_excerpt(t, F.lit(value))))
    text = "Report\nPatient:  Sarah\n  Johnson, seen\nend"
    assert find(text, "Sarah Johnson") == ("Patient:  Sarah\n  Johnson, seen", 17, 32) and text[17:32] == "Sarah\n  Johnson"
    assert find("Born  15 \t March\n1985 here", "1985-03-15")[1:] == (6, 21)
    assert find("a\nPatient: Sarah Jonson\nb", "Sarah Johnson")[1] == 11
    assert find("nobody here", "Sarah Johnson") == (None, None, None) and find("abd", "abc") == (None, None, None)


def every_window(text, excerpt, claimed=()):
    """The best of all windows, compared one by one."""
    n, best, found = len(excerpt), 0.0, None
    for w in range(max(1, int(n * 0.8)), min(int(n * 1.2) + 1, len(text) + 1)):
        for i in range(len(text) - w + 1):
            if all(i + w <= cs or i >= ce for cs, ce in claimed):
                r = SequenceMatcher(None, excerpt, text[i : i + w], autojunk=False).ratio()
                if r > best:
                    best, found = r, (i, i + w)
    return found if best >= (0.9 if n < 40 else 0.8) else None


def test_fuzzy_find_compares_every_window():
    # a template on many pages, the true place further on
    excerpt = "Findings of the chest: nodule of 14 mm in the left lower lobe."
    pages = "".join(f"Findings of the chest: nodule of {k} mm in the xxxxx upper part. " for k in range(20, 50))
    text = pages + excerpt.replace("left", "letf") + pages
    assert G.fuzzy_find(text, excerpt) == (len(pages), len(pages) + len(excerpt))
    # a change about every fifth letter leaves no five-letter piece whole
    worn = "".join("#" if i % 5 == 4 else c for i, c in enumerate(excerpt))
    assert G.fuzzy_find("aa " * 50 + worn + " bb" * 50, excerpt) == (150, 150 + len(excerpt))
    r = random.Random(5)
    for _ in range(60):
        source = "".join(r.choice("abcd ") for _ in range(140))
        s, n = r.randrange(90), r.choice((3, 6, 12, 20, 41, 45))
        asked = "".join(c for c in source[s : s + n] if r.random() > 0.06)
        asked = "".join(r.choice("abcd") if r.random() < 0.06 else c for c in asked)
        claimed = [(s, s + 3)] if r.random() < 0.3 else []
        assert G.fuzzy_find(source, asked, claimed) == every_window(source, asked, claimed)


def test_quality_and_gates(spark):
    good = "The chest CT shows a nodule in the right lung lobe with mild pleural effusion. " * 6
    assert one(spark, good, Q.quality)["overall"] > 0.7 > one(spark, "cl3@r p@t13nt x#9 l1v3r", Q.quality)["overall"]
    assert one(spark, "", Q.quality)["overall"] == 0.0
    rows = spark.createDataFrame([(0.9, 0.9, 1.0, True, 1.0, 1.0)], "score double, grounding double, numeric double, has_number boolean, exact_match double, passage_match double")
    assert all(r["passed"] for r in Q.query_gates(rows).collect()) and not Q.query_gates(rows.limit(0)).collect()[0]["passed"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("BMI,Sex\n20,F\nNA,M\n")
    df = R.read_source(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"BMI": "bigint", "Sex": "string"} and df.where("BMI is null").count() == 1
    with pytest.raises(FileNotFoundError):
        R.expand_sources(spark, str(tmp_path / "none*"))
    reports = spark.createDataFrame([(1, "CT", [("lung", "mass")]), (2, "CT", []), (3, "MR", None)], "id int, exam string, findings array<struct<anatomy:string,exam:string>>")
    assert [tuple(r) for r in W.findings_rows(reports).collect()] == [(1, "lung", "mass")]
    W.write_parquet(reports, str(tmp_path / "o"), "one_row")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_schemas(spark):
    spec = SC.normalize_spec({"name": "X", "fields": [{"name": "A b", "type": "string"}, {"name": "a_b", "type": "integer", "required": False}, {"name": "e", "type": "enum", "values": ["x", "X"]}]})
    assert [f["name"] for f in spec["fields"]] == ["a_b", "a_b_2", "e"] and spec["fields"][2]["values"] == ["x"] and not SC.spec_issues(spec)
    df = spark.createDataFrame([("1", "yes", "1,5"), ("2", "no", "2")], "i string, b string, f string")
    assert {r["column"]: r["type"] for r in SC.infer_columns(df).collect()} == {"i": "int", "b": "bool", "f": "float"}
    assert {tuple(r) for r in SC.schema_diff(SC.fields_of(df), SC.fields_of(df.drop("b"))).collect()} == {("b", "removed")}


def test_batches(spark, tmp_path):
    docs = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "")], "name string, text string")

    def run(t):
        if t == "bad":
            raise RuntimeError("no")
        return t.upper()

    out = str(tmp_path / "out")
    assert B.run_batch(docs, "name", "text", run, out) == {"total": 3, "succeeded": 1, "failed": 2, "skipped": 0}
    assert B.run_batch(docs, "name", "text", str.upper, out) == {"total": 3, "succeeded": 1, "failed": 1, "skipped": 1}


def test_html(spark):
    page = "<table><tr><th>A</th><th>B</th></tr><tr><td>1 &amp; 2</td><td><b>x</b></td></tr></table>"
    assert one(spark, page, R.html_table) == "| A | B |\n| --- | --- |\n| 1 & 2 | x |" and one(spark, "none", R.html_table) is None
    parts = one(spark, '<section id="s" data-section-name="N"><textarea>ok  then</textarea></section>', R.html_sections)
    assert [(p["id"], p["name"], p["text"]) for p in parts] == [("s", "N", "ok then")]


def test_word_blocks(spark):
    rows = [(1, i, c, float(i), 0.0, i + 1.0, 1.0) for i, c in enumerate("ab  cd")]
    got = G.word_blocks(spark.createDataFrame(rows, "d int, p int, c string, x0 double, y0 double, x1 double, y1 double"), "d", "p", "c").orderBy("block").collect()
    assert [(r["text"], r["start"], r["end"], r["x0"], r["x1"]) for r in got] == [("ab", 0, 2, 0.0, 2.0), ("cd", 4, 6, 4.0, 6.0)]
