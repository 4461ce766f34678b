import numpy as np
import pytest
from pyspark.sql import functions as F

from carrel.llm import packing as P

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(P.TOKENIZER), reason="no vocabulary files here")


def test_hilbert_neighbours():
    n = 8
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 3), -1).reshape(-1, 3)
    keys = P.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(n**3))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_round_trip(spark):
    texts = [(i, ("note %d about the liver and lung " % i) * (1 + i % 40), "c") for i in range(300)] + [(1000, "w " * 5000, "c"), (1001, "", "c"), (1002, None, "c"), (5, "note 5 about the liver and lung " * 6, "c")]
    texts += [(2000 + i, "the very same text again", "c") for i in range(200)]
    sized = P.sized_documents(spark.createDataFrame(texts, "doc_id long, text string, capacity_id string"), "doc_id", "text")
    sizes = {(r.doc_id, r.text_hash): r.tokens for r in sized.collect()}
    assert len(sizes) == 300 + 2 + 200
    packed = P.pack(sized, [(1, 64), (2, 512)]).cache()
    for cap_id, cap in ((1, 64), (2, 512)):
        rows = packed.where(F.col("capacity_id") == cap_id).collect()
        held, got = {}, {}
        for r in rows:
            n = r.token_end - r.token_start
            held[r.container_id] = held.get(r.container_id, 0) + n
            got.setdefault((r.doc_id, r.text_hash), []).append((r.token_start, r.token_end))
        assert max(held.values()) <= cap and set(got) == set(sizes)
        for k, spans in got.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == sizes[k] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert sizes[k] > cap or len(spans) == 1
        assert sum(held.values()) / (len(held) * cap) > 0.9
    assert P.pack(sized.limit(0), [(1, 64)]).count() == 0
