import random
import re

import pytest
from pyspark.sql import functions as F

from carrel.llm.splitting import evidence_chunks, unbroken_stretches, with_pieces


def brute(t, limit=1800):
    at, out = 0, []
    ends = [(m.start(), m.end()) for m in re.finditer(r"\s+", t) if "\n" in m[0] or (m.start() and t[m.start() - 1] in ".!?")]
    for a, b in [*ends, (len(t), len(t))]:
        if a - at > limit:
            out.append((at, a))
        at = b
    return out


def texts():
    r = random.Random(5)
    sentence = lambda n: " ".join("abcdefgh"[: r.randrange(1, 8)] for _ in range(n)) + r.choice(".!?")
    yield from ("", "short", "x" * 5000, ("y" * 1799 + ". ") * 3, "z" * 1800 + "\n" + "a" * 1801 + "  \n b", "word " * 3000, "é😀" * 3000, "a. " + " " * 4000 + "b")
    for _ in range(12):
        yield r.choice(("", "\n")).join(sentence(r.choice((5, 30, 700))) + r.choice((" ", "\n", "\n\n", "  ")) for _ in range(r.randrange(3, 30)))


def test_pieces_and_stretches(spark):
    rows = list(enumerate(texts()))
    docs = with_pieces(spark.createDataFrame([*rows, *rows, (99, None), (None, "x")], "id long, t string"), "id", "t")
    found = {}
    for r in unbroken_stretches(docs).collect():
        found.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
    got = {r.doc_id: r.pieces for r in docs.collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert sorted(found.get(i, [])) == brute(t), i
        pieces = got[i]
        assert "".join(t[p.core_start : p.char_end] for p in pieces) == t
        before = 0
        for p in pieces:
            assert p.char_end - p.char_start <= 1800 and (p.chunk_id == 0 or 0 <= before - p.char_start <= 220 or t[before : p.char_start].isspace())
            if not p.natural:
                assert any(a < p.char_end < b for a, b in brute(t)), (i, p)
            before = p.char_end


@pytest.mark.parametrize("limit, overlap", [(200, 40), (1000, 100)])
def test_other_limits(spark, limit, overlap):
    t = "One two three. " * 200 + "x" * 700
    pieces = with_pieces(spark.createDataFrame([(1, t)], "id long, t string"), "id", "t", limit, overlap).first().pieces
    assert max(p.char_end - p.char_start for p in pieces) <= limit and "".join(t[p.core_start : p.char_end] for p in pieces) == t


def test_evidence(spark):
    docs = with_pieces(spark.createDataFrame([(1, "Word one two. " * 400)], "id long, t string"), "id", "t")
    ev = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 1700, 5000), (3, 1, None, None), (4, 9, 0, 5), (5, 1, 30, 20)], "evidence_id long, loaded_id long, char_start long, char_end long")
    got = {r.evidence_id: (r.chunk_id, r.whole) for r in evidence_chunks(ev, docs).collect()}
    assert got[1] == (0, True) and got[2][1] is False and got[3][0] is None and got[4][0] is None and got[5][0] is None
    assert evidence_chunks(ev.where(F.lit(False)), docs).count() == 0
