import pytest

from carrel.llm import pii as P

LEX = P.Lexicon(frozenset({"ann", "torben"}), frozenset({"ostford", "brook", "lund"}))


@pytest.mark.parametrize(
    "text, found",
    [
        ("Dear Dr. Ann K. Ostford-Lund, thank you", [("NAME", "Ann K. Ostford-Lund")]), ("OSTFORD, Torben says", [("NAME", "OSTFORD, Torben")]), ("seen by torben\nostford today", [("NAME", "torben\nostford")]), ("Herr Ostford was seen", [("NAME", "Ostford")]), ("Ann says hello", [("NAME", "Ann")]),
        ("Ann sign was negative. Ostford score 3.", []), ("the brook was cold", []), ("Brook Clinic", []),
        ("a.b+c@x-y.example.org.", [("EMAIL", "a.b+c@x-y.example.org")]), ("a[at]b[dot]example[dot]net", [("EMAIL", "a[at]b[dot]example[dot]net")]), ("ann (at) clinic.invalid", [("EMAIL", "ann (at) clinic.invalid")]), ("Seen @ clinic 8 of it.", []),
        ("call (763) 555-0169 now", [("PHONE", "(763) 555-0169")]), ("(1 395/555 0102", [("PHONE", "1 395/555 0102")]), ("+49 (0)30 23125 757", [("PHONE", "+49 (0)30 23125 757")]), ("0044 20 79460882", [("PHONE", "0044 20 79460882")]), ("020 7946 0261", [("PHONE", "020 7946 0261")]), ("Readings were 118-122-4650 in sequence 194.", []), ("Request form 641 006 9522 was scanned", []),
        ("MRN 8460-6496", [("ID", "8460-6496")]), ("mrn#00097075", [("ID", "00097075")]), ("Social security no. 000 49 3514", [("ID", "000 49 3514")]), ("Passport XK7127250", [("ID", "XK7127250")]), ("Member no. VLM-79838-11", [("ID", "VLM-79838-11")]), ("Device serial 244-74-3143 was recorded", []), ("on 2024-01-02", []),
        ("at 175B JUNIPER LANE, 89002 Town", [("ADDRESS", "175B JUNIPER LANE")]), ("Lives at 7 Bramble St., X", [("ADDRESS", "7 Bramble St.")]), ("Lives at 7 Bramble Road. He", [("ADDRESS", "7 Bramble Road")]), ("Ziegelhofstr. 15a, X", [("ADDRESS", "Ziegelhofstr. 15a")]), ("Am Alten Wehr 115a", [("ADDRESS", "Am Alten Wehr 115a")]), ("P.O. Box 143\nX", [("ADDRESS", "P.O. Box 143")]),
        ("", []), (None, []), ("word " * 20000, []),
    ],
)
def test_details(text, found):
    assert [(k, text[s:e]) for k, s, e in P.find_details(text, LEX)] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("Seen today, 123-45-6789, in ward 2", ["123-45-6789"]), ("number 123 45 6789 given", ["123 45 6789"]), ("666-14-8332 and 000 86 9404", ["666-14-8332", "000 86 9404"]), ("taxpayer 912-70-1234", ["912-70-1234"]),
        ("123-00-6789", []), ("123-45-0000", []), ("912-10-1234", []), ("Device serial 611-07-7964 was recorded", []), ("dose 5 123 45 6789", []),
        ("born 1950, 943 476 5919, ward 2", ["943 476 5919"]), ("401 023 2137 on file", ["401 023 2137"]), ("401 023 2138 on file", []), ("Request form 943 476 5919 was scanned", []),
        ("insured XQ-79838-11 since", ["XQ-79838-11"]), ("Order XQ-79838-11 since", []),
    ],
)
def test_numbers_without_a_label(text, found):
    assert [text[s:e] for k, s, e in P.find_details(text, LEX) if k == "ID"] == found
    assert all(n not in P.redact(text, LEX, b"k") for n in found)


def test_phones_are_no_identity_numbers():
    for text in ("+49 123-45-6789", "call 943 476 5919", "+1 943 476 5919", "353 555 0128"):
        assert "ID" not in {k for k, _, _ in P.find_details(text, LEX)}


@pytest.mark.parametrize("n", range(1, 16))
def test_feistel_is_a_permutation(n):
    key = b"k"
    values = [str(i * 7919 % 10**n).zfill(n) for i in range(min(10**n, 200))]
    made = [P.feistel_digits(v, key) for v in values]
    assert all(len(m) == n for m in made) and len(set(made)) == len(set(values))
    if n > 1:
        assert [P.feistel_digits(m, key, back=True) for m in made] == values


def test_pseudonyms_keep_the_format():
    a, b = P.pseudonym_number("(763) 555-0169", b"k"), P.pseudonym_number("763-555-0169", b"k")
    assert [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()] and a[0] == "(" and P.pseudonym_number(a, b"k", back=True) == "(763) 555-0169"
    d = P.pseudonym_date("2024-02-29", b"k")
    assert P.pseudonym_date(d, b"k", back=True) == "2024-02-29"
    out = P.redact("Ann Ostford, MRN 8460-6496, again MRN 8460-6496.", LEX, b"k")
    assert out.startswith("[NAME ") and out.count("[ID ") == 2 and len({p[:9] for p in out.split("[ID ")[1:]}) == 1 and out.endswith(".")


def test_tables(spark):
    texts = spark.createDataFrame([("t", 1, "Patient: Torben Ostford, born"), ("t", 2, "Signed: Torben Lund, neurology"), ("t", 3, "Torben says"), ("t", 4, None)], "source_table string, record_id long, text string")
    lexicon = P.learn_lexicon(texts)
    assert lexicon.given == {"torben"}
    got = {(r.record_id, r.phi_text) for r in P.details(texts.where("text is not null"), lexicon, b"k").collect()}
    assert got == {(1, "Torben Ostford"), (2, "Torben Lund"), (3, "Torben")}
    assert P.redacted(texts, lexicon, b"k").count() == 4
    assert P.details(texts.limit(0), P.learn_lexicon(texts.limit(0)), b"k").count() == 0


def test_names_beyond_the_cap_are_found(spark):
    names = [("Torben", "Ostford"), ("Sunniva", "Lund"), ("Perrine", "O'Halberg")]
    rows = [("t", 10 * k + i, f"Patient: {g} {f}, born") for k, (g, f) in enumerate(names) for i in range(2 + k)]
    rows += [("t", 100 + k, f"later {g}'s cough; {f} says so, and {g.lower()} {f.lower()} too") for k, (g, f) in enumerate(names)] + [("t", 200, None)]
    texts = spark.createDataFrame(rows, "source_table string, record_id long, text string")
    whole, capped = P.learn_lexicon(texts), P.learn_lexicon(texts, most=1)
    assert len(whole.given) == 3 and len(capped.given) == 1
    some = texts.where("text is not null")
    want = sorted(map(tuple, P.details(some, whole, b"k").collect()))
    assert sorted(map(tuple, P.details(some, capped, b"k").collect())) == want and {r[1] for r in want} >= {100, 101, 102}
    hidden = lambda lexicon: sorted(map(tuple, P.redacted(some, lexicon, b"k").collect()))
    assert hidden(capped) == hidden(whole) and P.redacted(texts, capped, b"k").count() == len(rows)


def test_dates_stay_linked():
    text = "Seen 2024-02-29 and 29.02.2024, also 02/29/2024; born 31.02.1950, build 2024-02-291."
    made = P.redact(text, LEX, b"k", dates=True)
    new = P.pseudonym_date("2024-02-29", b"k")
    y, m, d = new.split("-")
    assert made == f"Seen {new} and {d}.{m}.{y}, also {m}/{d}/{y}; born 31.02.1950, build 2024-02-291."
    assert P.pseudonym_dates(made, b"k", back=True) == text and P.redact(text, LEX, b"k") == text


def test_details_carry_their_placeholder(spark):
    texts = spark.createDataFrame([("t", 1, "MRN 8460-6496"), ("t", 2, "call; MRN: 8460-6496, mail a.b@c.org")], "source_table string, record_id long, text string")
    rows = P.details(texts, P.Lexicon(frozenset(), frozenset()), b"k").collect()
    ids = {r.placeholder for r in rows if r.phi_type == "ID"}
    assert len(ids) == 1 and P.pseudonym_number(ids.pop()[4:-1], b"k", back=True) == "8460-6496"


def test_many_names_cost_no_more():
    import time

    text = "Seen by Torben Ostford; d'Arcy Lund's cough. " * 40
    few = P.Lexicon(frozenset({"torben", "d'arcy"}), frozenset({"ostford", "lund"}))
    many = P.Lexicon(few.given | {f"x{i}y" for i in range(50_000)}, few.family)
    P.find_details(text, few)
    spent = []
    for lexicon in (few, many):
        began = time.perf_counter()
        got = P.find_details(text, lexicon)
        spent.append(time.perf_counter() - began)
    assert got == P.find_details(text, few) and spent[1] < 5 * spent[0] + 0.05
