import pytest

from carrel.llm.canonical import Reference, map_findings, match_values

ROWS = [("A1", ["right upper lobe", "RUL"]), ("A2", ["right lower lobe"]), ("A3", ["left upper lobe"]), ("A4", ["liver", "Leber"]), ("A5", ["left adrenal gland"]), ("A6", ["right adrenal gland"]), ("A7", ["mild"]), ("A8", ["moderate", "mäßig", "grade 3"]), ("A9", ["minimal", "grade 1"])]
REF = Reference(ROWS)


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize(
    "typed, code",
    [("Rt. uper lobe", "A1"), ("RUL", "A1"), ("lobe, lower (rt)", "A2"), ("leftupper-lobe, lower pole", "A3"), ("Leebr ?", "A4"), ("adrenal gland (lt) - new", "A5"), ("moder.", "A8"), ("MÄSSIG", "A8"), ("mäig", "A8"), ("mld", "A7"), ("gade 3", "A8"), ("grade1", "A9"),
     ("adrenal gland", "NONE"), ("upper lobe", "NONE"), ("right upper limb", "NONE"), ("mild to moderate", "NONE"), ("m.", "NONE"), ("grade 2", "NONE"), ("7", "NONE"), ("???", "NONE"), ("x" * 3000, "NONE")],
)
def test_typed_values(typed, code):
    assert REF.best(typed)[0] == code


def test_automaton_against_brute_force():
    import random

    r = random.Random(1)
    paths = ["rightupperlobe", "rightlowerlobe", "liver", "leber", "mild"]
    ref = Reference([(p, [p]) for p in paths])
    for _ in range(400):
        s = list(r.choice(paths))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(s))
            s[k : k + r.randrange(2)] = r.choice("abelrtv")
        s = "".join(s)
        for limit in (0, 1, 2):
            got = ref.trie.within(s, limit)
            from carrel.llm.canonical import distance_limit

            want = {p: d for p in paths if (d := edits(s, p)) <= limit and d <= distance_limit(max(len(s), len(p)))}
            assert got == want, (s, limit)


def test_tables(spark):
    onto = spark.createDataFrame([(" Liver", "A4", "anatomy", ["Leber"]), ("mild", "S1", "severity", None), (None, "S2", "severity", None)], "term string, code string, vocabulary string, synonyms array<string>")
    finding = "findings array<struct<anatomy:string,observation:string,severity:string>>"
    rows = [(1, [("liver", "o", "n/a"), ("Lebr", None, "mlid"), None]), (1, [("liver", "o", "n/a"), ("Lebr", None, "mlid"), None]), (2, None), (3, []), (4, [(None, None, " "), ("toe", None, "-")])]
    got = {(r.report_id, r.finding_no, r.field_name, r.code) for r in map_findings(spark.createDataFrame(rows, f"report_id long, {finding}"), onto).collect()}
    assert got == {(1, 1, "anatomy", "A4"), (1, 1, "severity", "S1"), (4, 1, "anatomy", "NONE")}
    values = spark.createDataFrame([("anatomy", "Lebr"), ("severity", "mlid"), ("colour", "x")], "vocabulary string, value string")
    assert {(r.value, r.code) for r in match_values(values, onto, block_rows=1).collect()} == {("Lebr", "A4"), ("mlid", "S1"), ("x", "NONE")}
    assert match_values(values.limit(0), onto).count() == 0


def test_blocks_do_not_matter(spark):
    entries = [("A", "liver left lobe", None), ("B", "liver", None), ("C", "kidney", ["renal organ"]), ("D", "right upper abdominal wall muscle", None), ("E", "kidnez", None)]
    onto = spark.createDataFrame([(t, c, "anatomy", s) for c, t, s in entries], "term string, code string, vocabulary string, synonyms array<string>")
    typed = ["liver, left lobe", "liver, new", "left lobe (liver)", "liv. left lob.", "kidne", "kidney", "muscle, new, seen before, right, wall, upper, abdominal", "muscle abdominal upper right wall", "liver, a, b, c, d, left lobe", "kidn.", "toe", "liver" + ", left" * 400]
    values = spark.createDataFrame([("anatomy", v) for v in typed], "vocabulary string, value string")
    results = [{(r.value, r.code, r.distance) for r in match_values(values, onto, block_rows=n).collect()} for n in (20_000, 2, 1)]
    assert results[0] == results[1] == results[2]
    codes = {v: c for v, c, _ in results[0]}
    assert [codes[v] for v in typed[:-1]] == ["A", "B", "A", "A", "NONE", "C", "D", "D", "A", "NONE", "NONE"]
