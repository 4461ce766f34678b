from carrel.llm import scanrepair as R

SCHEMA = "loaded_id long, text string, pages array<struct<page_number:int,text:string,engine:string,confidence:double>>, ocr_engine_used string, extra int"
CLEAN = "The patient reported chest pain and nausea. The post-contrast images show a modern calcification in the left kidney. " * 5


def page(i, body, head="Mill Hospital - Medical Records"):
    return (i, f"{head}\n{body}\n- {i} -", "x", 0.9)


def filler(d, k):
    """Three lines that no other page has."""
    return "\n".join(f"Images of {w}{'abcdefgh'[d] * 3} show the kidney." for w in ("lor", "mun", "tas")[:k])


def rows():
    out = [(100 + i, CLEAN, None, None, 1) for i in range(4)]
    for d in range(4):
        p = [page(1, f"{filler(d, 3)}\nThe pat1ent {'abcdefgh'[d] * 2} reported chest pa-\nin and nausca in l2 people {'abcdefgh'[d] * 3}, and the post-"), page(2, f"contrast images {'abcdefgh'[d]} show a calci‐\nfication in the left kidney.\n{filler(d, 2)}", "Mi11 H0spital - Medical Rec0rds")]
        out.append((d, "\n\n".join(x[1] for x in p), p, "ocr", 1))
    # a page break as a form feed
    out.append((50, "\n\f".join(x[1] for x in [page(1, "The kidney"), page(2, "is modern.")]), None, "ocr", 1))
    return [*out, (60, None, None, "ocr", 1), (61, "", [], "ocr", 1), (None, "x", None, "ocr", 1), out[-1]]


def test_damage_and_paragraphs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r.loaded_id, r.line + 1, r.damage, r.repaired) for r in R.damage(df).collect()}
    first = {x[1:] for x in got if x[0] == 0}
    assert first == {
        (1, "furniture", ""), (7, "furniture", ""), (9, "furniture", ""), (14, "furniture", ""),
        (5, "misread", "patient"), (5, "hyphen", "pain"), (6, "misread", "nausea"), (6, "misread", "12"), (6, "hyphen", "post-contrast"), (10, "hyphen", "calcification"),
    }
    assert {x[1:3] for x in got if x[0] == 50} == {(1, "furniture"), (3, "furniture"), (4, "furniture"), (6, "furniture")}
    assert not {x for x in got if x[0] in (60, 61, 100)}
    texts = {r.loaded_id: r.text for r in R.repaired_texts(df).collect()}
    assert "The patient aa reported chest pain and nausea in 12 people aaa, and the post-contrast images a show a calcification in the left kidney." in texts[0]
    assert "Medical" not in texts[0] and "- 1 -" not in texts[0]
    assert texts[50] == "The kidney is modern."


def test_copies_of_a_scan_count_once(spark):
    text = "The nausca was mild and the kidney looked modern."
    clean = [(1000 + i, f"{CLEAN} {i}", None, None, 1) for i in range(4)]
    scans = [(i, text, None, "ocr", 1) for i in range(60)]
    got = {(r.loaded_id, r.repaired) for r in R.damage(spark.createDataFrame(clean + scans, SCHEMA)).collect() if r.damage == "misread"}
    assert got == {(i, "nausea") for i in range(60)}


def test_a_slip_in_a_clean_text_is_no_veto(spark):
    clean = [(1000 + i, f"{CLEAN} {i}", None, None, 1) for i in range(60)] + [(2000, "Severe nausca at night.", None, None, 1), (2001, "The calf and the half were sore.", None, None, 1)]
    scans = [(i, f"The nausca was mild {'abcdefgh'[i] * 3}.", None, "ocr", 1) for i in range(8)]
    got = {(r.loaded_id, r.repaired) for r in R.damage(spark.createDataFrame(clean + scans, SCHEMA)).collect() if r.damage == "misread"}
    assert got == {(i, "nausea") for i in range(8)}


def test_empty(spark):
    assert R.damage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_page_marks():
    assert R.page_mark("Seite l von 7") == ("form", 1) and R.page_mark("- 3 -") == ("form", 3) and R.page_mark("iv") == ("roman", 4) and R.page_mark("12") == ("bare", 12)
    assert R.page_mark("Page 3 of the outside report was not available.") is None and R.page_mark("x" * 5000) is None
    # a number in a table is no page number
    edges = [{"page": p, "line": 10 * p + k, "place": place, "mark": m, "number": n, "repeated": False} for p, n in ((0, 45), (1, 12)) for k, (place, m) in enumerate([(1, None), (-1, "bare")])]
    assert R.decide_edges(edges) == []


def test_numbers():
    assert R.fixed_number("l.6") == "1.6" and R.fixed_number("1S0") == "150" and R.fixed_number("4O") == "40"
    assert R.fixed_number("T2") is None and R.fixed_number("SOS") is None and R.fixed_number("12") is None


def test_strokes_are_shared_by_all_misreadings():
    for read, right in R.MISREADINGS:
        assert R.stroke_key(f"x{read}y") == R.stroke_key(f"x{right}y"), (read, right)
    assert R.misread_cost("nausca", "nausea") == 1 and R.misread_cost("rnodern", "modern") == 1 and R.misread_cost("nausca", "nausca") == 0 and R.misread_cost("abc", "xyz") is None
    # the same letter throughout is one change, as for short words
    assert R.misread_cost("hcpcc", "hepee") == 1 and R.readings("hcpcc")["hepee"] == 1
    for token in ("pat1cnt", "calci", "rnodcrn"):
        assert all(R.misread_cost(token, w) <= n for w, n in R.readings(token).items() if R.misread_cost(token, w) is not None)


def test_long_words_are_repaired(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis" * 3
    misread = long.replace("e", "c", 1).replace("m", "rn", 1).replace("u", "ii", 1)
    assert R.change_places(misread) > R.MOST_PLACES and len(misread) > 60
    clean = [(1000 + i, f"{CLEAN} {long} {i}", None, None, 1) for i in range(6)]
    scans = [(1, f"The {misread} was mild.", None, "ocr", 1)]
    got = {(r.loaded_id, r.repaired) for r in R.damage(spark.createDataFrame(clean + scans, SCHEMA)).collect() if r.damage == "misread"}
    assert got == {(1, long)}


def test_more_edge_lines():
    text = "\n".join(f"h{k}" for k in range(5)) + "\nbody\n" * 9
    assert len(R.page_edges(text, None)) == 6 and len(R.page_edges(text, None, 5)) == 10
