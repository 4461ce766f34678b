import pytest
from pyspark.sql import functions as F

from carrel.functions import quality as Q
from carrel.operators import extract as E
from carrel.operators import phi as P
from carrel.operators import schemas as SC
from carrel.operators import templates as TP
from carrel.sources import readers as R

YAML = """
name: Spine
description: levels
mode: radiology
sections:
  - {name: indication, type: str, required: true}
  - {name: grade, type: enum, required: false, values: [Mild, Severe]}
  - name: levels
    type: list
    required: false
    item:
      type: object
      fields:
        - {name: level, type: str}
        - {name: size_mm, type: float, required: false}
  - {name: tags, type: list, item: {type: str}}
"""


def test_yaml_round_trip(tmp_path):
    spec = TP.parse_template(YAML)
    assert spec["fields"][1]["values"] == ["Mild", "Severe", "None"] and [f["name"] for f in spec["fields"][2]["fields"]] == ["level", "size_mm"]
    assert TP.parse_template(TP.template_yaml(spec)) == spec
    assert TP.with_absence(["mild", "2"]) == ["mild", "2", "none"] and TP.with_absence(["Absent", "Mild"]) == ["Absent", "Mild"] and TP.with_absence([]) == []
    for bad in ("", "a: 1", "- x", "name: x\nsections: 3"):
        with pytest.raises(ValueError):
            TP.parse_template(bad)
    (tmp_path / "own.yaml").write_text(YAML)
    assert TP.resolve_template(str(tmp_path / "own.yaml"))[1] == "own" and TP.resolve_template("own", str(tmp_path))[0]["name"] == "Spine" and TP.resolve_template("chest_ct")[1] == "chest_ct" and TP.resolve_template(None) == (None, None)
    SC.save_spec({"name": "Kept", "fields": [{"name": "a", "type": "str"}]}, str(tmp_path / "store"))
    assert TP.resolve_template("Kept", None, str(tmp_path / "store"))[0]["name"] == "Kept"
    with pytest.raises(ValueError, match="not found"):
        TP.resolve_template("nothing")


def test_registries():
    assert len(P.CATEGORIES["hipaa"]) == 21 and P.list_rules() == ["default", "hipaa"] and P.get_rules("hipaa")
    with pytest.raises(KeyError, match="hipaa"):
        P.get_rules("other")
    assert Q.get_metric("radiology") and "schema" in Q.list_metrics()
    with pytest.raises(KeyError, match="radiology"):
        Q.get_metric("other")
    assert TP.get_mode("pathology") and TP.get_template("chest_ct").mode == "radiology" and TP.get_template("x") is None
    with pytest.raises(ValueError, match="pathology"):
        TP.get_mode("other")


def test_levels_and_chunks():
    spec = TP.parse_template(YAML)
    assert TP.think_level(spec) == "standard" and TP.effective_level("fast", spec) == "standard" and TP.effective_level("deep", None) == "deep" and TP.effective_level("auto", None) == "standard"
    assert TP.schema_chunks(spec) == [("scalars", ["indication", "grade", "tags"]), ("levels", ["levels"])]
    assert TP.think_level({"fields": [{"name": f"f{i}", "type": "str", "description": "number of x"} for i in range(9)]}) == "deep"
    assert 0 < TP.schema_quality({"fields": []}) < TP.schema_quality(SC.normalize_spec(spec)) <= 1


def test_specs_from_tables(spark):
    rows = [("size", None, None, "no", "1=small;2=large", None, 1), ("size", "enum", "how big", "yes", "3", "huge", 2), ("age", "int", "years", "no", None, None, 3), (" ", "int", None, None, None, None, 4)]
    df = spark.createDataFrame(rows, "Field_Name string, `field type` string, note string, mandatory string, code string, label string, o int")
    got = {r["name"]: r for r in TP.table_specs(df, "o").collect()}
    assert set(got) == {"size", "age"} and got["size"]["type"] == "enum" and got["size"]["required"] and got["size"]["values"] == ["1", "2", "3"] and got["size"]["labels"] == ["1=small", "2=large", "3=huge"] and got["age"]["place"] == 1
    assert TP.table_specs(df.limit(0), "o").count() == 0
    with pytest.raises(ValueError):
        TP.catalog_headers(["a"], {"name": "b"})


def test_payloads(spark):
    spec = SC.normalize_spec({"name": "N", "fields": [
        {"name": "age", "type": "int", "required": True}, {"name": "exam_date", "type": "str", "required": False}, {"name": "grade", "type": "enum", "values": ["mild", "severe"], "required": False}, {"name": "tags", "type": "list[str]"},
        {"name": "items", "type": "list", "fields": [{"name": "size", "type": "float", "required": False}]},
    ]})
    texts = ['{"age": "52", "exam_date": "soon", "grade": "quite severe", "tags": "one", "items": [{"size": "2.5"}, {}]}', "{}", "[1]", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.coerced_payload(F.col("t"), spec).alias("p"))
    rows = {r.i: r.p for r in df.collect()}
    assert rows[0].age == 52 and rows[0].grade == "severe" and rows[0].tags == ["one"] and [x.size for x in rows[0]["items"]] == [2.5, None]
    assert rows[1].age == 0 and rows[1].tags == [] and rows[2] is None and rows[3] is None and rows[4] is None
    assert df.where("i = 0").select(E.validated_payload(F.col("p"), spec).alias("p")).first().p.exam_date is None


def test_deidentify(spark):
    df = spark.createDataFrame([("Ann Lee, 555-123-4567, again ANN LEE", ["Ann Lee", "Ann"]), (None, None), ("", [])], "t string, v array<string>")
    both = [r[0] for r in df.select(P.deidentify(F.col("t"), F.col("v"))).collect()]
    assert both == ["[REDACTED], [REDACTED], again [REDACTED]", None, ""]
    assert df.select(P.deidentify(F.col("t"), mode="regex")).first()[0] == "Ann Lee, [REDACTED], again ANN LEE"
    with pytest.raises(ValueError):
        P.deidentify(F.col("t"), mode="pseudonymize")


def test_reading(spark, tmp_path):
    assert R.sniff_delimiter("a;b;c\n1;2,5;3\n") == ";" and R.sniff_delimiter("a\tb\n1\t2") == "\t" and R.sniff_delimiter("plain") == ","
    (tmp_path / "t.csv").write_text("﻿name ; two  words;\nx;1;\ny;;\n")
    got = R.read_delimited(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["name", "two words"] and {tuple(r) for r in got.collect()} == {("x", "1"), ("y", "")}
    (tmp_path / "e.jsonl").write_text('{"q": "a", "r": "b"}\n\n{"q": "c"}\n')
    rows = R.check_examples(spark, str(tmp_path / "e.jsonl"), ["q"], ["r"]).orderBy("line_no").collect()
    assert [(r.line_no, r.inputs["q"], r.labels["r"]) for r in rows] == [(1, "a", "b"), (3, "c", None)]
    with pytest.raises(ValueError, match="line 3: lacks r"):
        R.check_examples(spark, str(tmp_path / "e.jsonl"), ["q", "r"], [])
    (tmp_path / "bad.jsonl").write_text('{"q": "a"}\n{oops\n')
    with pytest.raises(ValueError, match="line 2: no JSON"):
        R.check_examples(spark, str(tmp_path / "bad.jsonl"), ["q"], [])
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no examples"):
        R.check_examples(spark, str(tmp_path / "empty.jsonl"), ["q"], [])
    assert R.expand_sources(spark, str(tmp_path))[0].endswith("bad.jsonl") and len(R.expand_sources(spark, str(tmp_path / "*.jsonl"))) == 3


def test_alignment(spark):
    rows = [("mail ann@example.org. 2024-01-02 and more", "mail [REDACTED]. [REDACTED] and more"), ("a 1 b 1 c", "a [REDACTED] b [REDACTED] c"), ("x 123", "x [REDACTED]"), ("same", "same"), (None, "x"), ("abc", "[REDACTED]")]
    got = [[(r.start, r.end, r.value) for r in x[0]] for x in spark.createDataFrame(rows, "a string, b string").select(P.align_redaction(F.col("a"), F.col("b"))).collect()]
    assert got == [[(5, 32, "ann@example.org. 2024-01-02")], [(2, 3, "1"), (6, 7, "1")], [(2, 5, "123")], [], [], [(0, 3, "abc")]]


def test_pages_lines_and_codes(spark):
    from carrel.operators import provenance as G

    spans = spark.createDataFrame([("d", 3, 8, "x"), ("d", 0, 2, "y"), ("e", 0, 1, "z")], "doc string, start int, end int, original string")
    pages = spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 7, 12)], "doc string, page int, start long, end long")
    got = {(r.doc, r.start): [tuple(p) for p in r.pages] for r in G.with_page_spans(spans, pages, "doc").collect()}
    assert got == {("d", 3): [(1, 3, 5), (2, 0, 1)], ("d", 0): [(1, 0, 2)], ("e", 0): []}
    boxes = [("p", 1, "right", 60.0, 11.0, 90.0, 20.0), ("p", 1, "left", 0.0, 10.0, 40.0, 19.0), ("p", 1, "below", 0.0, 30.0, 40.0, 39.0), ("p", 1, None, 0.0, 0.0, 1.0, 1.0)]
    lines = G.layout_lines(spark.createDataFrame(boxes, "doc string, page int, t string, x0 double, y0 double, x1 double, y1 double"), "doc", "page", "t").orderBy("line_no").collect()
    assert [r.text for r in lines] == ["left right", "below"]
    fields = spark.createDataFrame([("a", "name", "Ann Lee", "Seen: Ann Lee."), ("a", "age", "99", "Seen: Ann Lee.")], "id string, path string, value string, text string")
    offsets = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 5, 14)], "id string, page int, start long, end long")
    block = {x.field: x for x in G.source_block(fields, "id", "text", offsets).first().source_block}
    assert block["name"].page == 2 and block["name"].grounded and not block["age"].grounded and block["age"].page is None
    page = '<script type="text/xml"><entry origtxt="f"><code meaning="Findings" value="1-2" scheme="LOINC"/></entry></script>'
    df = spark.createDataFrame([(page,), ("<p>none</p>",), (None,)], "h string").select(R.loinc_entries(F.col("h")).alias("m"))
    maps = [r.m for r in df.collect()]
    assert maps[0]["f"].code == "1-2" and maps[0]["f"].meaning == "Findings" and not maps[1] and maps[2] is None


def test_confidence_and_levels(spark):
    from carrel.operators import verify as V
    from carrel.plans.answers import answer_confidence

    assert answer_confidence("how many?", "There are 5.", []) == 0.0
    stat = [{"source": "t", "snippet": "Computed nunique of sex: 5", "score": 80, "evidence_type": "table_stat", "value": 5}]
    values = [{"source": "t", "snippet": f"Distinct sex: {v} (count=1)", "score": 84, "evidence_type": "table_value", "value": v} for v in ("F", "M")]
    assert answer_confidence("how many sexes?", "There are 5 values.", stat) >= 0.78 and answer_confidence("list the sexes", "Values: F, M.", values) >= 0.82
    assert answer_confidence("list the sexes", "X=3, Y=4", values) < 0.74
    text = [{"source": "n", "snippet": "the CT shows a nodule", "score": 1, "evidence_type": "text"}]
    assert answer_confidence("what does the scan show?", "It measures 24 mm", text) < answer_confidence("what does the scan show?", "shows a nodule", text)
    rows = spark.createDataFrame([(1, "size 5", "size 5 here")], "id int, c string, s string")
    assert V.verify_claims(rows, "id", "c", "s").first().verdict == "verified"
    with pytest.raises(ValueError):
        V.verify_claims(rows, "id", "c", "s", "deep")
