"""Queries of this subpackage by name, with the SQL oracles that exist."""

from __future__ import annotations

from carrel.llm.canonical import p2_found, p2_unmatched
from carrel.llm.crosssplit import p1_found, p1_overlap_by_source
from carrel.llm.leakage import p8_found, p8_leaked_items
from carrel.llm.packing import p7_containers, p7_fill
from carrel.llm.pii import p3_found, p3_redacted
from carrel.llm.scanrepair import p4_found, p4_paragraphs
from carrel.llm.splitting import p6_evidence, p6_found, p6_pieces
from carrel.llm.textkind import p9_found, p9_statistics
from carrel.llm.textnorm import LOOKALIKES

QUERIES = {
    "p1_found": p1_found,
    "p1_overlap_by_source": p1_overlap_by_source,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_evidence": p6_evidence,
}
# Words as p1_found compares them: look-alike letters as Latin ones, accents and case off, runs of letters or digits.
_ALIKE = [(c, p) for c, p in LOOKALIKES.items() if len(p) == 1]
_WORDS = (
    "regexp_extract_all(translate(replace(lower(strip_accents({t})), 'ß', 'ss'), '" + "".join(c for c, _ in _ALIKE) + "', '" + "".join(p for _, p in _ALIKE) + "'), '[\\p{{L}}\\p{{N}}]+')"
)
_PAIRS = f"""
WITH n AS (SELECT DISTINCT 0 AS side, record_id, document_text FROM extract_train WHERE document_text IS NOT NULL AND record_id IS NOT NULL UNION ALL SELECT DISTINCT 1, record_id, document_text FROM extract_test WHERE document_text IS NOT NULL AND record_id IS NOT NULL),
w AS (SELECT side, record_id, md5(document_text) AS note, unnest({_WORDS.format(t='document_text')}) AS word FROM n),
c AS (SELECT side, record_id, note, word, count(*) AS k FROM w GROUP BY ALL),
z AS (SELECT side, record_id, note, sum(k) AS size FROM c GROUP BY ALL),
p AS (SELECT a.record_id AS train_id, a.note AS train_note, b.record_id AS test_id, b.note AS test_note, sum(least(a.k, b.k)) AS shared FROM c a JOIN c b ON a.word = b.word AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT p.*, shared / greatest(x.size, y.size) AS overlap FROM p JOIN z x ON x.side = 0 AND x.record_id = train_id AND x.note = train_note JOIN z y ON y.side = 1 AND y.record_id = test_id AND y.note = test_note WHERE shared >= 0.8 * greatest(x.size, y.size)"""
ORACLES: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT train_id, test_id FROM ({_PAIRS})",
    "p1_overlap_by_source": f"""
WITH h AS (SELECT test_id, count(*) AS pairs, sum(overlap) AS total FROM ({_PAIRS}) GROUP BY test_id),
t AS (SELECT record_id AS test_id, min({{'a': eval_split, 'b': source_name}}) AS s FROM extract_test WHERE record_id IS NOT NULL GROUP BY record_id)
SELECT s.a AS eval_split, s.b AS source_name, count(*) AS test_notes, count(pairs) AS overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs, round(sum(total) / sum(pairs), 6) AS mean_overlap FROM t LEFT JOIN h USING (test_id) GROUP BY 1, 2""",
    "p6_found": """
WITH t AS (SELECT DISTINCT loaded_id, text FROM loaded_document WHERE text IS NOT NULL AND loaded_id IS NOT NULL AND length(text) > 1800),
s AS (SELECT loaded_id, text, regexp_extract_all(regexp_replace(text, '([.!?])(\\s+)', '\\1' || chr(2) || '\\2', 'g'), '(?:[^\\s\\x02]+(?:[^\\S\\n]+[^\\s\\x02]+)*)|[\\s\\x02]+') AS parts FROM t),
u AS (SELECT loaded_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s),
l AS (SELECT loaded_id, i, parts[i] AS part, list_sum(list_transform(parts[1:i - 1], lambda x: length(replace(x, chr(2), '')))) AS place FROM u)
SELECT DISTINCT loaded_id, CAST(coalesce(place, 0) AS BIGINT) AS char_start, CAST(coalesce(place, 0) + length(part) AS BIGINT) AS char_end FROM l WHERE NOT regexp_matches(part, '^[\\s\\x02]+$') AND length(part) > 1800""",
}
