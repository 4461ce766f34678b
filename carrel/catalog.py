"""All core queries by name, over the supplied tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel import oracles
from carrel.functions import quality as Q
from carrel.functions import text as X
from carrel.operators import extract as E
from carrel.operators import phi as P
from carrel.operators import provenance as G
from carrel.operators import schemas as SC
from carrel.operators import search as S
from carrel.operators import sections as SE
from carrel.operators import tables as T
from carrel.operators import templates as TP
from carrel.operators import verify as V
from carrel.operators.units import p5_found
from carrel.plans import answers as AN
from carrel.plans import planner as PL
from carrel.plans.guard import guarded_sql
from carrel.session import shared_folder, table
from carrel.sources import readers as R
from carrel.sources import writers as W
from carrel.streaming import batch as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"p5_found": p5_found}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded, for sums whose last digits depend on the order of the rows."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- statistics -----------------------------------------------------------------------------------------------------
_SQL_STAT = {
    "mean": "avg({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "sum": "sum({c})", "std": "stddev_samp({c})", "count": "count({c})", "nunique": "count(DISTINCT {c})", "missing_count": "count(*) - count({c})",
}
for _op, _expr in _SQL_STAT.items():
    _e = _expr.format(c="l_extendedprice")
    query(f"stat_{_op}", f"SELECT round(CAST({_e} AS DOUBLE), 4) AS value, count(*) AS row_count, count(l_extendedprice) AS non_null FROM lineitem")(
        lambda spark, d, op=_op: T.table_stat(table(spark, d, "lineitem"), "l_extendedprice", op).withColumn("value", F.round(F.col("value").cast("double"), 4))
    )
    query(f"stat_{_op}_grouped", f"SELECT l_returnflag AS grp, round(CAST({_expr.format(c='l_quantity')} AS DOUBLE), 4) AS value FROM lineitem GROUP BY l_returnflag ORDER BY value DESC NULLS LAST, grp NULLS LAST LIMIT 10")(
        lambda spark, d, op=_op: T.table_stat(table(spark, d, "lineitem"), "l_quantity", op, group_by="l_returnflag").withColumn("value", F.round(F.col("value").cast("double"), 4))
    )


@query("stat_where", "SELECT round(avg(l_quantity), 4) AS value, count(*) AS row_count, count(l_quantity) AS non_null FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'")
def stat_where(spark, d):
    return T.table_stat(table(spark, d, "lineitem"), "L Quantity", "avg", where="l_discount > 0.05 AND l_returnflag = 'R'").withColumn("value", F.round("value", 4))


@query("row_count", "SELECT count(*) AS value FROM orders")
def row_count(spark, d):
    return PL.compile_plan(PL.Plan("count_rows", "orders"), table(spark, d, "orders"))


@query("distinct_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def distinct_values(spark, d):
    return T.distinct_values(table(spark, d, "orders"), "o_orderpriority")


@query("distinct_values_where", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL AND (value > 10 OR user_id < 5) GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def distinct_values_where(spark, d):
    return T.distinct_values(table(spark, d, "events"), "event_type", where="value > 10 OR user_id < 5")


_SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS uniques FROM customer"
    for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))
)


@query("table_schema", _SCHEMA_SQL)
def table_schema(spark, d):
    return T.table_schema(table(spark, d, "customer"))


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM part"
    for c in ("p_partkey", "p_size", "p_retailprice")
)


@query("table_profile_numeric", _PROFILE_SQL)
def table_profile_numeric(spark, d):
    out = T.numeric_profile(table(spark, d, "part"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "median", "p75")})


@query("table_profile_topk", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def table_profile_topk(spark, d):
    return T.top_values(table(spark, d, "part"), "p_brand")


@query("id_candidates", """
SELECT c AS "column", CAST(round(100.0 * u / nn) AS INT) AS score, nn AS non_null, u AS uniques, round(u / nn, 6) AS unique_ratio, role FROM (
  SELECT 'c_custkey' AS c, count(c_custkey) AS nn, count(DISTINCT c_custkey) AS u, count(*) AS n, 'numeric' AS role FROM customer
  UNION ALL SELECT 'c_name', count(c_name), count(DISTINCT c_name), count(*), 'categorical' FROM customer
  UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey), count(*), 'numeric' FROM customer
  UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(DISTINCT c_acctbal), count(*), 'numeric' FROM customer
  UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), count(*), 'categorical' FROM customer) t
WHERE nn >= greatest(3, floor(n * 0.5)) AND u / nn >= 0.95""")  # fmt: skip
def id_candidates(spark, d):
    return T.id_candidates(table(spark, d, "customer"))


@query("column_roles")
def column_roles(spark, d):
    return spark.createDataFrame(sorted(T.column_roles(table(spark, d, "documents")).items()), "column string, role string")


@query("sample_head", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def sample_head(spark, d):
    return T.sample_rows(table(spark, d, "nation"), "head", 5, ["N Nationkey", "n_name"])


@query("sample_tail", "SELECT * FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def sample_tail(spark, d):
    return T.sample_rows(table(spark, d, "nation"), "tail", 5)


@query("sample_random")
def sample_random(spark, d):
    return T.sample_rows(table(spark, d, "orders"), "random", 20)


@query("project_columns", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 400000")
def project_columns(spark, d):
    o = T.filtered(table(spark, d, "orders"), "o_totalprice > 400000")
    return o.select(*[T.quoted(T.resolve_column(o, c)) for c in ("O_ORDERKEY", "o orderpriority")])


# ---- read-only SQL --------------------------------------------------------------------------------------------------
_PASS = {
    "window": "SELECT rnk, count(*) AS orders, min(o_totalprice) AS least, max(o_totalprice) AS most FROM (SELECT o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders) GROUP BY rnk ORDER BY rnk",
    "cte": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t GROUP BY n ORDER BY n",
    "setop": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "join": "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "semi": "SELECT c_nationkey, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey ORDER BY c_nationkey",
    "anti": "SELECT c_nationkey, count(*) AS customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000) GROUP BY c_nationkey ORDER BY c_nationkey",
}
for _name, _sql in _PASS.items():
    query(f"sql_passthrough_{_name}", _sql)(
        lambda spark, d, sql=_sql: guarded_sql(spark, sql, {t: table(spark, d, t) for t in ("orders", "customer", "nation", "supplier")}, 500)
    )

_REFUSED = {
    "write": "WITH t AS (SELECT 1 AS a) INSERT INTO orders SELECT * FROM t", "file": "SELECT * FROM text.`/etc/hostname`", "foreign": "SELECT * FROM part", "nested": "SELECT * FROM orders WHERE o_custkey IN (SELECT c FROM csv.`/etc/passwd`)",
    "two": "SELECT 1; SELECT 2", "command": "DROP TABLE orders", "function": "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "read": "SELECT count(*) FROM orders",
}


@query("sql_guard", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'false' if k == 'read' else 'true'})" for k in _REFUSED) + ") AS t(statement, refused)")
def sql_guard(spark, d):
    """Statements that must be refused, and one that must not."""

    def refused(sql):
        try:
            guarded_sql(spark, sql, {"orders": table(spark, d, "orders")})
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(v)) for k, v in _REFUSED.items()], "statement string, refused boolean")


# ---- row search -----------------------------------------------------------------------------------------------------


_SEARCHED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_CELL = "lower(CAST({c} AS VARCHAR))"


@query("search_tables_rows", f"""
WITH h AS (SELECT c_custkey, list_filter([{', '.join(f"{{'n': '{c}', 'v': CAST({c} AS VARCHAR), 'k': CAST(contains({_CELL.format(c=c)}, 'building') AS INT) + CAST(contains({_CELL.format(c=c)}, '15') AS INT)}}" for c in _SEARCHED)}], lambda x: x.k > 0) AS m FROM customer),
s AS (SELECT *, list_sum(list_transform(m, lambda x: x.k)) AS score FROM h WHERE len(m) > 0)
SELECT 'customer' AS source, c_custkey AS row_key, CAST(score AS INT) AS score, 'row ' || c_custkey || ': ' || array_to_string(list_transform(m[1:4], lambda x: x.n || '=' || x.v), ', ') AS snippet, 'table_row' AS evidence_type FROM s ORDER BY score DESC, c_custkey LIMIT 5""")  # fmt: skip
def search_tables_rows(spark, d):
    return T.search_rows(table(spark, d, "customer"), "building 15", "customer", "c_custkey")


# ---- text -----------------------------------------------------------------------------------------------------------
_STEM = "CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%s' AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END"


@query("tokens_freq", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {_STEM} AS term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)) GROUP BY term")
def tokens_freq(spark, d):
    return S.term_frequencies(table(spark, d, "documents"), "text")


def _hits_sql(wanted: list[str], text: str) -> str:
    inside = ", ".join(f"'{t}'" for t in wanted)
    return f"len(list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: {_STEM}), lambda t: t IN ({inside})))"


_LESION = X.question_terms("lesion in the liver")


@query("doc_search_topk", f"""
WITH s AS (SELECT doc_id AS source, text, {_hits_sql(_LESION, 'text')} AS score FROM documents),
b AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, source LIMIT 5),
l AS (SELECT source, score, unnest(string_split_regex(text, '\\r\\n|\\n|\\r|\\f')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r|\\f'), 1) AS pos FROM b)
SELECT source, CAST(score AS INT) AS score, snippet, 'text' AS evidence_type FROM (
  SELECT source, score, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS snippet, row_number() OVER (PARTITION BY source ORDER BY {_hits_sql(_LESION, "line")} DESC, pos) AS n FROM l) WHERE n = 1""")  # fmt: skip
def doc_search_topk(spark, d):
    return S.search_documents(table(spark, d, "documents"), "doc_id", "text", "lesion in the liver")


_CHUNK_SQL = "SELECT doc_id, CAST(i AS INT) AS chunk_id, CAST(i * 1580 AS INT) AS \"start\", CAST(least(i * 1580 + 1800, length(text)) AS INT) AS \"end\", substring(text, CAST(i * 1580 + 1 AS BIGINT), 1800) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 1800, 0) / 1580.0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)"


@query("doc_chunks", f'SELECT doc_id, chunk_id, "start", "end", CAST(length(text) AS INT) AS char_count, md5(text) AS digest FROM ({_CHUNK_SQL})')
def doc_chunks(spark, d):
    return S.document_chunks(table(spark, d, "documents"), "doc_id", "text").withColumn("digest", F.md5("text")).drop("text")


@query("chunk_search_topk", f"""SELECT doc_id AS source, chunk_id, "start", "end", CAST(score AS INT) AS score, 'text_chunk' AS evidence_type FROM (SELECT *, {_hits_sql(_LESION, 'text')} AS score FROM ({_CHUNK_SQL})) WHERE score > 0 ORDER BY score DESC, doc_id, chunk_id LIMIT 8""")
def chunk_search_topk(spark, d):
    return S.search_chunks(table(spark, d, "documents"), "doc_id", "text", "lesion in the liver").drop("snippet")


@query("chunk_snippets")
def chunk_snippets(spark, d):
    return S.search_chunks(table(spark, d, "documents"), "doc_id", "text", "lesion in the liver")


def _count_sql(t: str) -> str:
    return f"(length(low) - length(replace(low, '{t}', ''))) / {len(t)}"


@query("chunk_audit_search")
def chunk_audit_search(spark, d):
    return S.audit_chunks(table(spark, d, "documents"), "doc_id", "text", "chest pain")


@query("chunk_phrase_search")
def chunk_phrase_search(spark, d):
    return S.phrase_positions(table(spark, d, "documents"), "doc_id", "text", "chest pain")


@query("phrase_overlaps", """
SELECT o_orderkey AS source, CAST(i - 1 AS INT) AS "start" FROM (SELECT o_orderkey, k, unnest(range(1, length(k))) AS i FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || CAST(o_custkey AS VARCHAR) AS k FROM orders))
WHERE substring(k, i, 2) = '11'""")  # fmt: skip
def phrase_overlaps(spark, d):
    """A phrase that can overlap itself."""
    keys = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("k"))
    return S.phrase_positions(keys, "o_orderkey", "k", "11").drop("snippet")


@query("number_inventory")
def number_inventory(spark, d):
    return S.number_inventory(table(spark, d, "documents"), "doc_id", "text")


@query("merge_hits_dedupe")
def merge_hits_dedupe(spark, d):
    docs = table(spark, d, "documents")
    return S.merge_hits([S.search_chunks(docs, "doc_id", "text", "liver lesion"), S.search_documents(docs, "doc_id", "text", "liver lesion")])


@query("citations_ranked")
def citations_ranked(spark, d):
    return S.diverse_citations(S.ranked_citations(merge_hits_dedupe(spark, d), "liver lesion", 20), 8)


@query("citation_confidence")
def citation_confidence(spark, d):
    return S.citation_confidence(citations_ranked(spark, d), "liver lesion size", "the liver lesion measures 24 mm")


@query("literal_support", "SELECT (CAST(max(CAST(contains(lower(text), 'liver') AS INT)) AS DOUBLE) + max(CAST(contains(lower(text), 'unicorn') AS INT))) / 2 AS support FROM documents")
def literal_support(spark, d):
    return S.literal_support(table(spark, d, "documents").select(F.col("text").alias("snippet")), ["liver", "Unicorn"])


@query("measure_delta", r"""
WITH h AS (SELECT doc_id, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*(mm|cm)\b')) AS h FROM documents),
m AS (SELECT DISTINCT doc_id, day, round(CAST(regexp_extract(h, '^(\d+(\.\d+)?)', 1) AS DOUBLE) * CASE WHEN h LIKE '%cm' THEN 10 ELSE 1 END, 4) AS mm FROM h)
SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, (SELECT max(mm) FROM m WHERE day = (SELECT min(day) FROM m)) AS first_mm, (SELECT max(mm) FROM m WHERE day = (SELECT max(day) FROM m)) AS last_mm,
round((SELECT max(mm) FROM m WHERE day = (SELECT max(day) FROM m)) - (SELECT max(mm) FROM m WHERE day = (SELECT min(day) FROM m)), 4) AS delta FROM m""")  # fmt: skip
def measure_delta(spark, d):
    out = S.measure_delta(S.dated_measures(table(spark, d, "documents"), "doc_id", "text", "created_at"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


# ---- de-identification ----------------------------------------------------------------------------------------------
def _notes(spark, d):
    return table(spark, d, "extract_train").select("record_id", "document_text").distinct()


# RE2 without (?U): the notes hold no digits or word signs outside ASCII beside letters in names, which no pattern touches.
_RE2 = [(k, p.replace("(?U)", "").replace("(?iuU)", "(?i)").replace("(?iU)", "(?i)")) for k, p in P.PATTERNS]
_LEAK_SQL = " OR ".join(f"regexp_matches(document_text, '{p}')" for _, p in _RE2)
_SCRUB_SQL = "document_text"
for _k, _p in _RE2:
    _SCRUB_SQL = f"regexp_replace({_SCRUB_SQL}, '{_p}', '[REDACTED]', 'g')"


@query("phi_leak", f"SELECT record_id, md5(document_text) AS digest, CASE WHEN {_LEAK_SQL} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS leak FROM (SELECT DISTINCT record_id, document_text FROM extract_train)")
def phi_leak(spark, d):
    return _notes(spark, d).select("record_id", F.md5("document_text").alias("digest"), P.leak_score(F.col("document_text")).alias("leak"))


@query("phi_scrubbed", f"SELECT record_id, md5({_SCRUB_SQL}) AS digest FROM (SELECT DISTINCT record_id, document_text FROM extract_train)")
def phi_scrubbed(spark, d):
    return _notes(spark, d).select("record_id", F.md5(P.scrub(F.col("document_text"))).alias("digest"))


_SPAN_PARTS = " UNION ALL ".join(f"SELECT record_id, '{k}' AS kind, len(regexp_extract_all(document_text, '{p}')) AS n FROM (SELECT DISTINCT record_id, document_text FROM extract_train)" for k, p in _RE2)


@query("phi_matches_by_type", f"SELECT kind AS phi_type, CAST(sum(n) AS BIGINT) AS n FROM ({_SPAN_PARTS}) GROUP BY kind HAVING sum(n) > 0")
def phi_matches_by_type(spark, d):
    rows = _notes(spark, d).select(F.explode(P.all_spans(F.col("document_text"))).alias("s"))
    return rows.groupBy(F.col("s.kind").alias("phi_type")).agg(F.count("*").alias("n"))


@query("phi_spans")
def phi_spans(spark, d):
    return P.phi_spans(_notes(spark, d), "record_id", "document_text")


@query("phi_redacted")
def phi_redacted(spark, d):
    n = _notes(spark, d)
    return n.select("record_id", P.redact_spans(F.col("document_text"), P.merge_spans(P.all_spans(F.col("document_text")))).alias("text"))


@query("phi_summary")
def phi_summary(spark, d):
    return P.phi_summary(phi_spans(spark, d), "record_id")


@query("phi_context")
def phi_context(spark, d):
    notes = _notes(spark, d).select(F.concat_ws("-", "record_id", F.md5("document_text")).alias("note"), "document_text")
    return P.with_context(P.phi_spans(notes, "note", "document_text"), notes, "note", "document_text")


@query("phi_entities_redacted")
def phi_entities_redacted(spark, d):
    """Values of phi_entity replaced in the notes they belong to."""
    values = table(spark, d, "phi_entity").where("record_id IS NOT NULL AND trim(value_text) <> ''").groupBy("record_id").agg(F.collect_set("value_text").alias("v"))
    return _notes(spark, d).join(values, "record_id").select("record_id", P.redact_values(F.col("document_text"), F.col("v")).alias("text"))


@query("phi_entity_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(value_text, '{p}') THEN '{k}'" for k, p in _RE2) + " ELSE 'OTHER' END AS kind FROM phi_entity WHERE value_text IS NOT NULL) GROUP BY kind")
def phi_entity_kinds(spark, d):
    rows = table(spark, d, "phi_entity").where("value_text IS NOT NULL")
    return rows.groupBy(P.span_kind(F.col("value_text")).alias("kind")).agg(F.count("*").alias("n"))


# ---- sections, extraction -------------------------------------------------------------------------------------------
def _scans(spark, d):
    return table(spark, d, "loaded_document").select("loaded_id", "text").distinct()


@query("section_split")
def section_split(spark, d):
    return SE.sections(_scans(spark, d), "loaded_id", "text")


@query("label_blocks")
def label_blocks(spark, d):
    return SE.labelled_blocks(_notes(spark, d), "record_id", "document_text")


_WORDS = "len(list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> ''))"


@query("section_complexity", f"""
SELECT doc_id, CASE WHEN w <= 70 AND g <= 20 AND NOT m AND NOT b THEN 'easy' WHEN w >= 260 OR g >= 80 OR m OR b THEN 'hard' ELSE 'moderate' END AS hint FROM (
  SELECT doc_id, len(list_filter(string_split_regex(text, '[\\s\\x0B\\x{{00a0}}]+'), lambda w: w <> '')) AS w, len(regexp_extract_all(text, '\\d')) AS g, regexp_matches(text, '(?i)\\b\\d+(\\.\\d+)?\\s*(mm|cm|kg|mg|ml|%|x10\\^?\\d+)\\b') AS m, regexp_matches(text, '\\b[A-Za-z_]+\\s*\\|\\s*[A-Za-z_]+') AS b FROM documents)""")  # fmt: skip
def section_complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", SE.complexity(F.col("text")).alias("hint"))


@query("routed_context")
def routed_context(spark, d):
    scans = _scans(spark, d).select(F.concat_ws("-", "loaded_id", F.md5("text")).alias("scan"), "text")
    return SE.routed_context(scans, "scan", "text")


@query("focused_context")
def focused_context(spark, d):
    scans = _scans(spark, d).select(F.concat_ws("-", "loaded_id", F.md5("text")).alias("scan"), "text")
    return SE.focused_context(scans, "scan", "text", ["medication", "history", "findings"])


@query("label_backfill")
def label_backfill(spark, d):
    return SE.backfill(_notes(spark, d), "record_id", "document_text", ["patient_name", "name", "visit_date"])


def _extracted(spark, d, dialect="verify"):
    """Fields of the extractions with their notes; flat: the note with single blanks, made once for all its fields."""
    rows = table(spark, d, "extract_train").where("extracted IS NOT NULL").select("record_id", "document_text", "extracted").distinct().withColumn("flat", X.squash(F.col("document_text")))
    return rows.select("record_id", "document_text", "flat", F.inline(E.flattened(F.col("extracted"), dialect)))


@query("field_flatten", """
SELECT record_id, k AS path, CAST(json_extract_string(extracted, '$.' || k) AS VARCHAR) AS value FROM (
  SELECT record_id, extracted, unnest(json_keys(extracted)) AS k FROM (SELECT DISTINCT record_id, document_text, extracted FROM extract_train WHERE json_valid(extracted)))
WHERE json_type(extracted, '$.' || k) NOT IN ('ARRAY', 'OBJECT', 'BOOLEAN', 'NULL')
UNION ALL
SELECT record_id, k || '[' || i || ']' AS path, json_extract_string(extracted, '$.' || k || '[' || i || ']') AS value FROM (
  SELECT record_id, extracted, k, unnest(range(0, CAST(json_array_length(extracted, '$.' || k) AS BIGINT))) AS i FROM (
    SELECT record_id, extracted, unnest(json_keys(extracted)) AS k FROM (SELECT DISTINCT record_id, document_text, extracted FROM extract_train WHERE json_valid(extracted))) WHERE json_type(extracted, '$.' || k) = 'ARRAY')
WHERE json_type(extracted, '$.' || k || '[' || i || ']') NOT IN ('ARRAY', 'OBJECT', 'BOOLEAN', 'NULL')""")
def field_flatten(spark, d):
    return _extracted(spark, d).select("record_id", "path", "value")


@query("json_path_get", "SELECT record_id, json_extract_string(extracted, '$.medication[0]') AS first_medication FROM (SELECT DISTINCT record_id, extracted FROM extract_train WHERE extracted IS NOT NULL)")
def json_path_get(spark, d):
    rows = table(spark, d, "extract_train").where("extracted IS NOT NULL").select("record_id", "extracted").distinct()
    return rows.select("record_id", E.json_get(F.col("extracted"), "medication[0]").alias("first_medication"))


@query("semantic_checks")
def semantic_checks(spark, d):
    return _extracted(spark, d).select("record_id", "path", E.semantic_check(F.col("path"), F.col("value")).alias("c")).select("record_id", "path", "c.*")


@query("grounding_snippet")
def grounding_snippet(spark, d):
    g = E.ground(F.col("flat"), F.col("value"), True)
    return _extracted(spark, d).select("record_id", "path", "value", g.alias("g")).select("record_id", "path", "value", "g.grounded", "g.snippet")


@query("contract")
def contract(spark, d):
    rows = _extracted(spark, d).withColumnRenamed("path", "field")
    return E.contract(rows, "record_id", F.col("flat"), True)


@query("contract_counts")
def contract_counts(spark, d):
    return E.contract_counts(contract(spark, d), "record_id")


@query("candidate_scores")
def candidate_scores(spark, d):
    rows = table(spark, d, "extract_train").where("extracted IS NOT NULL").select("record_id", "document_text", "extracted").distinct()
    # the schema asks for a name and texts: what is no object, or names nobody, does not fit
    fits = F.try_variant_get(F.try_parse_json("extracted"), "$.patient_name", "string").isNotNull()
    c = E.candidate_score(E.flattened(F.col("extracted"), "candidate"), F.col("document_text"), ["patient_name", "primary_diagnosis"], fits)
    return rows.select("record_id", F.md5("document_text").alias("note"), c.alias("c")).select("record_id", "note", "c.score", *[F.round(f"c.{x}", 6).alias(x) for x in ("evidence", "completeness", "grounding", "contradiction", "null_overuse")])


@query("derived_counts", """
SELECT report_id, count(*) AS n, count(*) FILTER (lower(trim(flag)) IN ('yes', 'positive', '1', 'true', 'ja') OR TRY_CAST(flag AS DOUBLE) > 0) AS flagged, max(CAST(round_even(extent / (len * 10) * 100, 0) AS DOUBLE)) AS worst FROM (
  SELECT report_id, CASE WHEN severity IN ('severe', 'moderate') THEN 'ja' WHEN severity = 'mild' THEN '0' ELSE 'no' END AS flag, finding_no + 1.0 AS extent, length(anatomy) + 0.0 AS len FROM (SELECT DISTINCT report_id, finding_no, severity, anatomy FROM radiology_mode_output WHERE report_id IS NOT NULL AND length(anatomy) > 0))
GROUP BY report_id""")  # fmt: skip
def derived_counts(spark, d):
    """Counts of entries and of true flags, and the largest percentage, over the findings of a report."""
    rows = table(spark, d, "radiology_mode_output").where("report_id IS NOT NULL AND length(anatomy) > 0").select("report_id", "finding_no", "severity", "anatomy").distinct()
    flag = F.when(F.col("severity").isin("severe", "moderate"), "ja").when(F.col("severity") == "mild", "0").otherwise("no")
    items = rows.groupBy("report_id").agg(F.collect_list(F.struct(flag.alias("flag"), (F.col("finding_no") + 1.0).alias("extent"), (F.length("anatomy") + 0.0).alias("len"))).alias("items"))
    return items.select("report_id", F.size("items").cast("bigint").alias("n"), E.count_where(F.col("items"), "flag").cast("bigint").alias("flagged"), E.max_percentage(F.col("items"), "extent", "len").cast("double").alias("worst"))


_GONE = "({c} IS NULL OR lower(trim({c})) IN ('', 'none', 'null', 'nil', 'n/a', 'na', 'not available'))"


@query("consistency_issues", f"""
WITH r AS (SELECT DISTINCT report_id, exam_type, impressions, site_id, findings, length(site_id) AS stated FROM radiology_train)
SELECT report_id, field, issue, severity, count(*) AS n FROM (
  SELECT report_id, 'exam_type' AS field, 'required_field_missing' AS issue, 'error' AS severity FROM r WHERE {_GONE.format(c='exam_type')}
  UNION ALL SELECT report_id, 'impressions', 'required_field_missing', 'error' FROM r WHERE {_GONE.format(c='impressions')}
  UNION ALL SELECT report_id, 'number_findings', 'count_mismatch', 'warning' FROM r WHERE stated <> len(findings)
  UNION ALL SELECT report_id, 'site_id', 'invalid_enum_value', 'warning' FROM r WHERE site_id NOT IN ('S001', 'S002', 'S003', 'S007')) GROUP BY ALL""")
def consistency_issues(spark, d):
    """Required values, a stated number of findings (here the length of the site's name) and the allowed sites."""
    rows = table(spark, d, "radiology_train").select("report_id", "exam_type", "impressions", "site_id", "findings").distinct()
    issues = E.consistency_issues(
        {"exam_type": F.col("exam_type"), "impressions": F.col("impressions")}, {"number_findings": (F.length("site_id"), F.col("findings"))}, {"site_id": (F.col("site_id"), ["S001", "S002", "S003", "S007"])}
    )
    return rows.select("report_id", F.inline(issues)).groupBy("report_id", "field", "issue", "severity").agg(F.count("*").alias("n"))


@query("enum_coerced")
def enum_coerced(spark, d):
    rows = table(spark, d, "radiology_mode_output").select("finding_id", "severity").distinct()
    return rows.select("finding_id", "severity", E.coerce(F.col("severity"), "enum", options=["absent", "minimal", "mild", "moderate", "severe", "critical"]).alias("option"), E.trinary(F.col("severity")).alias("trinary"))


@query("missing_values", "SELECT count(*) AS n, count(*) FILTER (measurement IS NULL OR lower(trim(measurement)) IN ('', 'none', 'null', 'nil', 'n/a', 'na', 'not available')) AS missing FROM radiology_mode_output")
def missing_values(spark, d):
    return table(spark, d, "radiology_mode_output").agg(F.count("*").alias("n"), F.count(F.when(X.is_missing(F.col("measurement")), 1)).alias("missing"))


# ---- verification ---------------------------------------------------------------------------------------------------
@query("extraction_verify")
def extraction_verify(spark, d):
    return V.extraction_reports(V.field_verdicts(_extracted(spark, d), "record_id", "document_text"), "record_id", ids=table(spark, d, "extract_train"))


@query("field_verdicts")
def field_verdicts(spark, d):
    return V.field_verdicts(_extracted(spark, d), "record_id", "document_text")


@query("high_risk_fields")
def high_risk_fields(spark, d):
    return V.high_risk_fields(_extracted(spark, d), "record_id")


@query("claim_verify", r"""
SELECT item_id, CASE WHEN miss = 0 AND r > 0.5 THEN 'verified' WHEN r > 0.3 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS verdict, round(CASE WHEN miss = 0 AND r > 0.5 THEN least(0.95, r) ELSE r END, 6) AS confidence FROM (
  SELECT item_id, len(list_filter(regexp_extract_all(response, '\d+(?:\.\d+)?'), lambda n: NOT contains(source_text, n))) AS miss,
    len(list_intersect(list_distinct(regexp_extract_all(lower(response), '[a-z0-9]+')), regexp_extract_all(lower(source_text), '[a-z0-9]+'))) / len(list_distinct(regexp_extract_all(lower(response), '[a-z0-9]+'))) AS r
  FROM eval_item WHERE response IS NOT NULL)""")  # fmt: skip
def claim_verify(spark, d):
    rows = table(spark, d, "eval_item").where("response IS NOT NULL")
    return rows.select("item_id", V.claim_check(F.col("response"), F.col("source_text")).alias("c")).select("item_id", "c.verdict", "c.confidence")


@query("claim_decision")
def claim_decision(spark, d):
    rows = _claims(spark, d).withColumn("c", V.claim_check(F.col("claim"), F.col("source_text")))
    compared = V.value_comparison(F.col("claim"), F.col("source_text"))
    x = V.final_decision(F.col("c.verdict"), F.col("c.confidence"), compared, F.size("c.missing") > 0, F.col("c.confidence") > 0.5)
    return rows.select("item_id", "claim_no", compared.alias("comparison"), x.alias("x")).select("item_id", "claim_no", "comparison", "x.*")


def _claims(spark, d):
    """Claims with the sentences they are checked against: each sentence of a source as it is, and with its first digit turned into a 9."""
    items = table(spark, d, "eval_item").select("item_id", "source_text").distinct()
    parts = items.select("item_id", F.posexplode(F.split(F.regexp_replace("source_text", r"([.!?])\s+", "$1\n"), "\n")).alias("k", "source_text"))
    both = F.array(F.struct((F.col("k") * 2).alias("claim_no"), F.col("source_text").alias("claim")), F.struct((F.col("k") * 2 + 1).alias("claim_no"), F.regexp_replace("source_text", r"^(\D*)\d", "$19").alias("claim")))
    return parts.select("item_id", "source_text", F.inline(both))


@query("report_merge")
def report_merge(spark, d):
    return V.merged_report(field_verdicts(spark, d).select("record_id", V.status_name(F.col("status")).alias("status")), "record_id")


@query("verification_citations")
def verification_citations(spark, d):
    parts = field_verdicts(spark, d).where("excerpt IS NOT NULL").select(F.col("record_id").cast("string").alias("source"), F.col("excerpt").alias("snippet"), F.lit("evidence").alias("part"), F.lit(1).alias("score"))
    return V.verification_citations(parts)


# ---- provenance -----------------------------------------------------------------------------------------------------
def _pages(spark, d):
    docs = table(spark, d, "loaded_document").where("pages IS NOT NULL").groupBy("loaded_id").agg(F.min("pages").alias("pages"))
    return docs.select("loaded_id", F.inline("pages"))


_PAGES_SQL = "(SELECT loaded_id, p.page_number AS page_number, p.text AS text, p.confidence AS confidence FROM (SELECT loaded_id, unnest(pages) AS p FROM (SELECT loaded_id, min(pages) AS pages FROM loaded_document WHERE pages IS NOT NULL GROUP BY loaded_id)))"


@query("assemble_pages", f"SELECT loaded_id, count(*) AS page_count, round(avg(confidence), 3) AS confidence, coalesce(min(confidence) < 0.8, false) AS quality_warning, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_number)) AS digest FROM {_PAGES_SQL} GROUP BY loaded_id")
def assemble_pages(spark, d):
    return G.assemble_pages(_pages(spark, d), "loaded_id", "page_number", "text", "confidence").withColumn("digest", F.md5("text")).drop("text")


_OFFSETS = f"(SELECT loaded_id, page_number, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY loaded_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(coalesce(text, '')) AS n FROM {_PAGES_SQL})"


@query("page_offsets", f'SELECT loaded_id, page_number, CAST(s AS BIGINT) AS "start", CAST(s + n AS BIGINT) AS "end" FROM {_OFFSETS}')
def page_offsets(spark, d):
    return G.page_offsets(_pages(spark, d), "loaded_id", "page_number", "text")


@query("span_pages", f"""SELECT DISTINCT e.loaded_id, e.evidence_id, o.page_number AS page, 0.0::DOUBLE AS x0, CAST(o.page_number AS DOUBLE) AS y0, 100.0::DOUBLE AS x1, CAST(o.page_number + 1 AS DOUBLE) AS y1
FROM (SELECT DISTINCT evidence_id, loaded_id, char_start, char_end FROM outlines_evidence) e JOIN {_OFFSETS} o ON e.loaded_id = o.loaded_id AND o.s < e.char_end AND o.s + o.n > e.char_start""")  # fmt: skip
def span_pages(spark, d):
    blocks = page_offsets(spark, d).withColumnRenamed("page_number", "page").withColumns({"x0": F.lit(0.0), "y0": F.col("page").cast("double"), "x1": F.lit(100.0), "y1": (F.col("page") + 1).cast("double")})
    spans = table(spark, d, "outlines_evidence").select("loaded_id", "evidence_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")).distinct()
    return G.span_pages(spans, blocks, "loaded_id", "evidence_id")


@query("tight_excerpts")
def tight_excerpts(spark, d):
    rows = _extracted(spark, d)
    return rows.select("record_id", "path", G.tight_excerpt(F.col("document_text"), F.col("value")).alias("e")).select("record_id", "path", "e.*")


@query("evidence_resolved")
def evidence_resolved(spark, d):
    docs = table(spark, d, "loaded_document").groupBy("loaded_id").agg(F.max("text").alias("text"))
    excerpts = table(spark, d, "outlines_evidence").where("excerpt IS NOT NULL").groupBy("loaded_id").agg(F.array_sort(F.collect_set(F.struct(F.col("evidence_id").cast("string").alias("field"), "excerpt"))).alias("e"))
    return docs.join(excerpts, "loaded_id").select("loaded_id", F.inline(G.resolve_evidence(F.col("text"), F.col("e"))))


# ---- quality and metrics --------------------------------------------------------------------------------------------
_VOCAB = ", ".join(f"'{w}'" for w in Q.MEDICAL_WORDS)


@query("quality_vocabulary", f"SELECT doc_id, round(least(1.0, h / n / 0.30), 6) AS vocabulary FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ({_VOCAB}))) AS h, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z][\\p{{L}}\\p{{N}}_\\p{{M}}''-]*') AS w FROM documents)) WHERE n > 0")
def quality_vocabulary(spark, d):
    rows = table(spark, d, "documents").where(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))) > 0)
    return rows.select("doc_id", F.round(Q.vocabulary_score(F.col("text")), 6).alias("vocabulary"))


@query("quality_score")
def quality_score(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.quality(F.col("text")).alias("q")).select("doc_id", "q.*")


@query("completeness", """
SELECT report_id, round((CAST(coalesce(trim(exam_type) <> '', false) AS INT) + CAST(coalesce(len(findings) > 0, false) AS INT) + 0.3 * CAST(coalesce(trim(report_header) <> '', false) AS INT)) / 2.3, 6) AS overall,
(CAST(coalesce(trim(exam_type) <> '', false) AS INT) + CAST(coalesce(len(findings) > 0, false) AS INT)) / 2.0 AS required_coverage, CAST(CAST(coalesce(trim(report_header) <> '', false) AS INT) AS DOUBLE) AS optional_coverage FROM radiology_train""")
def completeness(spark, d):
    c = Q.report_completeness({"exam_type": Q.populated(F.col("exam_type")), "findings": Q.populated(F.col("findings"), "array")}, {"report_header": Q.populated(F.col("report_header"))})
    return table(spark, d, "radiology_train").select("report_id", c.alias("c")).select("report_id", F.round("c.overall", 6).alias("overall"), "c.required_coverage", "c.optional_coverage")


def _scored(spark, d):
    e = table(spark, d, "eval_item").where("response IS NOT NULL")
    q, r, s = F.col("question"), F.col("response"), F.col("source_text")
    rows = e.select(
        "item_id", Q.groundedness(q, r, s).alias("grounding"), Q.numeric_exactness(r, s).alias("numeric"), r.rlike(r"\d").alias("has_number"), Q.exact_match(r, s).alias("exact_match"), Q.passage_match(r, s).alias("passage_match")
    )
    return rows.withColumn("score", Q.query_score(F.col("grounding"), F.col("numeric"), F.col("has_number")))


def _overlap_sql(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct(regexp_extract_all(lower({a}), '[a-z0-9]+')), regexp_extract_all(lower({b}), '[a-z0-9]+'))) / len(list_distinct(regexp_extract_all(lower({a}), '[a-z0-9]+')))"


@query("metric_grounding", f"SELECT item_id, round(0.45 * {_overlap_sql('question', 'source_text')} + 0.55 * {_overlap_sql('response', 'source_text')}, 6) AS grounding, round({_overlap_sql('response', 'source_text')}, 6) AS passage_match FROM eval_item WHERE response IS NOT NULL")
def metric_grounding(spark, d):
    return _scored(spark, d).select("item_id", F.round("grounding", 6).alias("grounding"), F.round("passage_match", 6).alias("passage_match"))


@query("metric_query")
def metric_query(spark, d):
    return r6(_scored(spark, d), "grounding", "numeric", "passage_match", "score")


@query("quality_gates")
def quality_gates(spark, d):
    return Q.query_gates(_scored(spark, d))


@query("eval_summary")
def eval_summary(spark, d):
    return r6(Q.summary_stats(_scored(spark, d), "score"), "mean", "median", "std", "min", "max")


def _labelled(spark, d):
    """What plain patterns read from the notes: the predictions that are measured against the extractions."""
    notes = table(spark, d, "extract_train").where("extracted IS NOT NULL").select("record_id", "document_text").distinct()
    text = F.col("document_text")
    name, day = F.regexp_extract(text, r"Patient: ([A-Z][a-z]+ [A-Z][A-Za-z-]+)", 1), F.regexp_extract(text, r"(\d{4}-\d\d-\d\d)", 1)
    both = F.array(F.struct(F.lit("patient_name").alias("path"), name.alias("value")), F.struct(F.lit("visit_date").alias("path"), day.alias("value")))
    rows = notes.select("record_id", F.inline(both)).where("value <> ''")
    return rows.groupBy("record_id", "path").agg(F.min("value").alias("value"))


@query("metric_extract")
def metric_extract(spark, d):
    """Names and dates that patterns read from a note, against its extraction."""
    gold = table(spark, d, "extract_train").where("extracted IS NOT NULL").select("record_id", F.inline(E.flattened(F.col("extracted"), "metrics"))).groupBy("record_id", "path").agg(F.min("value").alias("value"))
    return Q.extraction_pairs(gold, _labelled(spark, d), "record_id")


def _report_pairs(spark, d):
    """Reports with the findings and exam as given, and as a pipeline read them."""
    gold = table(spark, d, "radiology_train").where("findings IS NOT NULL").select("report_id", "findings", "exam_type", "impressions", "report_header").distinct()
    found = table(spark, d, "radiology_mode_output").where("report_id IS NOT NULL").select("report_id", "finding_no", "anatomy", "observation").distinct()
    found = found.groupBy("report_id").agg(F.collect_list(F.struct("anatomy", "observation")).alias("found"))
    return gold.join(found, "report_id", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<anatomy:string,observation:string>>)")))


@query("metric_reports")
def metric_reports(spark, d):
    r = _report_pairs(spark, d)
    reward = 0.7 * Q.finding_reward(F.col("found")) + 0.3 * Q.impression_reward(F.col("impressions"))
    score = Q.radiology_metric(reward, F.col("found"), F.col("findings"), F.col("report_header"), F.col("exam_type"))
    path = Q.pathology_metric(F.col("found"), F.col("findings"), F.col("report_header"), F.col("exam_type"), "observation")
    return r.select("report_id", F.round(score, 6).alias("radiology"), F.round(path, 6).alias("pathology"), F.size("found").alias("found"))


@query("metric_summaries")
def metric_summaries(spark, d):
    """Impressions as summaries of the report texts, and texts scrubbed of identifiers against the originals."""
    r = table(spark, d, "radiology_train").where("report_text IS NOT NULL").select("report_id", "report_text", "impressions").distinct()
    scrubbed = P.scrub(F.col("report_text"))
    return r.select("report_id", F.md5("report_text").alias("report"), F.round(Q.summary_metric(F.col("report_text"), F.col("impressions")), 6).alias("summary"), F.round(Q.deidentify_metric(P.leak_score(scrubbed), F.col("report_text"), scrubbed), 6).alias("deidentified"))


@query("metric_verify")
def metric_verify(spark, d):
    """Verdicts of claims against what is known of them: those taken over unchanged are true."""
    rows = _claims(spark, d).withColumn("c", V.claim_check(F.col("claim"), F.col("source_text")))
    gold = F.when(F.col("claim") == F.col("source_text"), "verified").otherwise("partially_supported")
    return rows.select("item_id", "claim_no", F.round(Q.verify_score(gold, F.col("c.verdict"), F.col("c.confidence")), 6).alias("score"), (gold == F.col("c.verdict")).alias("hit"), "c.confidence")


@query("verify_gates")
def verify_gates(spark, d):
    rows = metric_verify(spark, d).select("score", F.when(F.col("hit"), 1.0).otherwise(0.0).alias("verdict_match"), "confidence")
    return Q.verify_gates(rows)


@query("ontology_lookup", "SELECT r.finding_id, o.code FROM (SELECT DISTINCT finding_id, anatomy FROM radiology_mode_output) r JOIN (SELECT DISTINCT lower(trim(term)) AS t, code FROM ontology_result WHERE vocabulary = 'anatomy') o ON lower(trim(r.anatomy)) = o.t")
def ontology_lookup(spark, d):
    o = table(spark, d, "ontology_result").where("vocabulary = 'anatomy'").select(F.lower(F.trim("term")).alias("t"), "code").distinct()
    r = table(spark, d, "radiology_mode_output").select("finding_id", F.lower(F.trim("anatomy")).alias("t")).distinct()
    return r.join(o, "t").select("finding_id", "code").distinct()


@query("score_categories")
def score_categories(spark, d):
    rows = [(s, c) for s, cs in SC.SCORES.items() for c in [*cs, "none"]] + [("Other", "1")]
    df = spark.createDataFrame(rows, "system string, category string")
    return df.select("system", "category", SC.score_description(F.col("system"), F.col("category")).alias("description"))


# ---- sinks, schemas, batches ----------------------------------------------------------------------------------------
@query("export_findings_rows", "SELECT report_id, exam_type, f.anatomy AS anatomy, f.observation AS observation, f.severity AS severity FROM (SELECT report_id, exam_type, unnest(findings) AS f FROM radiology_train)")
def export_findings_rows(spark, d):
    return W.findings_rows(table(spark, d, "radiology_train").select("report_id", "exam_type", "findings"))


@query("export_one_row", "SELECT report_id, exam_type, CAST(len(findings) AS BIGINT) AS n FROM radiology_train WHERE findings IS NOT NULL")
def export_one_row(spark, d):
    flat = W.one_row(table(spark, d, "radiology_train").where("findings IS NOT NULL").select("report_id", "exam_type", "findings"))
    return flat.select("report_id", "exam_type", F.json_array_length("findings").cast("bigint").alias("n"))


@query("export_markdown")
def export_markdown(spark, d):
    return table(spark, d, "radiology_train").select("report_id", W.markdown(F.coalesce("exam_type", F.lit("Report")), {"Site": F.col("site_id")}, F.col("findings"), F.col("impressions")).alias("markdown"))


@query("export_bundles")
def export_bundles(spark, d):
    return table(spark, d, "radiology_train").select("report_id", W.clinical_bundle(F.col("report_id"), F.col("exam_type"), F.col("findings"), F.col("impressions")).alias("bundle"))


@query("infer_columns", """
SELECT 'o_orderkey' AS "column", 'int' AS type, count(*) = count(o_orderkey) AS required, count(DISTINCT o_orderkey) AS uniques, count(o_orderkey) AS filled FROM orders
UNION ALL SELECT 'o_orderstatus', 'enum', count(*) = count(o_orderstatus), count(DISTINCT o_orderstatus), count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'float', count(*) = count(o_totalprice), count(DISTINCT o_totalprice), count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderpriority', 'enum', count(*) = count(o_orderpriority), count(DISTINCT o_orderpriority), count(o_orderpriority) FROM orders""")
def infer_columns(spark, d):
    return SC.infer_columns(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


@query("catalog_fields", "SELECT '' AS split, vocabulary AS name, count(DISTINCT trim(term)) AS n FROM ontology_result WHERE trim(term) <> '' GROUP BY vocabulary")
def catalog_fields(spark, d):
    out = SC.catalog_fields(table(spark, d, "ontology_result"), "vocabulary", "term", "code")
    return out.select("split", "name", F.size("values").cast("bigint").alias("n"))


@query("schema_diff", "SELECT * FROM (VALUES ('o_orderstatus', 'removed'), ('o_custkey', 'modified'), ('extra', 'added')) AS t(field, change)")
def schema_diff(spark, d):
    o = table(spark, d, "orders")
    return SC.schema_diff(SC.fields_of(o), SC.fields_of(o.drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("extra", F.lit(1))))


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.pending(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("completed_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def completed_semi_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.completed(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("process_documents")
def process_documents(spark, d):
    return B.process(table(spark, d, "documents"), "doc_id", "text", lambda t: str(len(t.split())))


@query("unique_source_names", "SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || ' (' || n || ')' END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL)")
def unique_source_names(spark, d):
    return R.unique_names(table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", "source"), "source", "doc_id").drop("source")


@query("combined_sources", "SELECT record_id, md5(string_agg(document_text, chr(10) || chr(10) ORDER BY document_text)) AS digest FROM (SELECT DISTINCT record_id, document_text FROM extract_train WHERE record_id IS NOT NULL AND document_text IS NOT NULL) GROUP BY record_id")
def combined_sources(spark, d):
    """The different notes of a record as one text."""
    out = V.combined_sources(_notes(spark, d).where("record_id IS NOT NULL AND document_text IS NOT NULL"), "record_id", "document_text", "document_text")
    return out.select("record_id", F.md5("text").alias("digest"))


@query("question_plan")
def question_plan(spark, d):
    """Plans of some questions over orders."""
    o = table(spark, d, "orders")
    asked = ["what is the average o_totalprice?", "how many rows are there?", "how many distinct o_custkey?", "breakdown of o_orderpriority", "which columns are there?"]
    rows = [(q, (p := PL.plan_question(q, "orders", o)).intent, p.column, p.operation) for q in asked]
    return spark.createDataFrame(rows, "question string, intent string, column string, operation string")


@query("question_answer", "SELECT round(avg(o_totalprice), 4) AS value, count(*) AS row_count, count(o_totalprice) AS non_null FROM orders")
def question_answer(spark, d):
    o = table(spark, d, "orders")
    return PL.compile_plan(PL.plan_question("what is the average o_totalprice?", "orders", o), o).withColumn("value", F.round("value", 4))


# ---- layout ---------------------------------------------------------------------------------------------------------
@query("word_blocks", """
WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), u AS (SELECT p_partkey, unnest(range(1, len(w) + 1)) AS i, w FROM s)
SELECT p_partkey, i AS block, w[i] AS text, list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - length(w[i]) - 1 AS "start", list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - 1 AS "end",
CAST(list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - length(w[i]) - 1 AS DOUBLE) AS x0, CAST(list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - 1 AS DOUBLE) AS x1 FROM u""")  # fmt: skip
def word_blocks(spark, d):
    """Characters of part names as boxes of width 1, joined to words."""
    chars = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("pos", "c"))
    boxed = chars.select("p_partkey", "pos", "c", F.col("pos").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("pos") + 1).cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    return G.word_blocks(boxed, "p_partkey", "pos", "c").select("p_partkey", F.col("block").cast("bigint").alias("block"), "text", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "x0", "x1")


def _html(spark, d):
    """Reports as pages: findings as a table, the impression as a section."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("")), F.lit("</td>"))
    r = table(spark, d, "radiology_train").where("findings IS NOT NULL").select("report_id", "findings", "impressions").distinct()
    rows = F.array_join(F.transform("findings", lambda f: F.concat(F.lit("<tr>"), cell(f["anatomy"]), cell(f["severity"]), F.lit("</tr>"))), "")
    part = F.concat(F.lit('<section id="i1" data-section-name="Impression"><textarea>'), F.coalesce("impressions", F.lit("")), F.lit("</textarea></section>"))
    return r.select("report_id", F.concat(F.lit("<table><tr><th>Anatomy</th><th>Severity</th></tr>"), rows, F.lit("</table>")).alias("page"), part.alias("section"))


@query("html_tables_md")
def html_tables_md(spark, d):
    return _html(spark, d).select("report_id", R.html_table(F.col("page")).alias("table"))


@query("html_sections", "SELECT DISTINCT report_id, 'i1' AS id, 'Impression' AS name, trim(regexp_replace(impressions, '\\s+', ' ', 'g')) AS text FROM radiology_train WHERE findings IS NOT NULL AND trim(coalesce(impressions, '')) <> ''")
def html_sections(spark, d):
    rows = _html(spark, d).select("report_id", F.inline(R.html_sections(F.col("section"))))
    return rows.where("text <> ''").distinct()


@query("source_snippets")
def source_snippets(spark, d):
    rows = _extracted(spark, d)
    return rows.select("record_id", "path", G.source_snippet(F.col("document_text"), F.col("value")).alias("snippet"))



# ---- questions and answers ------------------------------------------------------------------------------------------
def _session(spark, d):
    s = PL.QuerySession(spark)
    s.add_table("orders", table(spark, d, "orders"))
    s.add_table("customer", table(spark, d, "customer"))
    return s


_ASKED = [
    "what is the average o_totalprice?", "how many rows are in orders?", "how many distinct o_custkey?", "what is the breakdown of o_orderpriority?", "which columns are in customer?", "how many columns are there?", "list the values of c_mktsegment", "and how many are there?",
    "what is the maximum c_acctbal?", "how many o_orderstatus values are there?", "what is the average weather?",
]


@query("session_answers", """
SELECT * FROM (
SELECT 0 AS turn, 'aggregate' AS intent, 'orders' AS source, 'The mean of o_totalprice is ' || round(avg(o_totalprice), 4) || '.' AS answer FROM orders
UNION ALL SELECT 1, 'count_rows', 'orders', 'There are ' || count(*) || ' rows in orders.' FROM orders
UNION ALL SELECT 2, 'count_distinct', 'orders', 'There are ' || count(DISTINCT o_custkey) || ' distinct o_custkey values.' FROM orders
UNION ALL SELECT 3, 'count_values', 'orders', 'o_orderpriority distribution: ' || string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) || '.' FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 4, 'schema', 'customer', 'customer has 5 columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment'
UNION ALL SELECT 6, 'list_values', 'customer', 'Values of c_mktsegment: ' || string_agg(v, ', ' ORDER BY n DESC, v) || '.' FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)
UNION ALL SELECT 7, 'count_values', 'customer', 'There are ' || count(*) || ' distinct c_mktsegment values: ' || string_agg(v, ', ' ORDER BY n DESC, v) || '.' FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)
UNION ALL SELECT 8, 'aggregate', 'customer', 'The max of c_acctbal is ' || round(max(c_acctbal), 4) || '.' FROM customer
UNION ALL SELECT 9, 'count_distinct', 'orders', 'There are ' || count(DISTINCT o_orderstatus) || ' distinct o_orderstatus values.' FROM orders
UNION ALL SELECT 10, 'text_qa', '', 'No computed value supports an answer.')""")  # fmt: skip
def session_answers(spark, d):
    """Answers of one session, follow-ups included."""
    s = _session(spark, d)
    rows = []
    for q in _ASKED:
        a = s.ask(q)
        text = a.answer if not isinstance(a.value, float) else f"The {a.plan.operation} of {a.plan.column} is {_plain(round(a.value, 4))}."
        rows.append((a.turn, a.plan.intent, a.plan.source, text))
    # which of two tables a bare question about columns means is not settled
    return spark.createDataFrame([r for r in rows if r[0] != 5], "turn int, intent string, source string, answer string")


def _plain(x: float) -> str:
    return repr(x)


@query("session_payload", "SELECT * FROM (VALUES ('aggregate', true, 'deterministic', 'deterministic_tabular', '', 29), ('text_qa', false, 'retrieval', 'retrieval', 'missing_computed_evidence', 29)) AS t(intent, computed, mode, path, code, keys)")
def session_payload(spark, d):
    """The result of an answered and of a refused question."""
    s = _session(spark, d)
    rows = []
    for q in ("what is the average o_totalprice?", "what is the average weather?"):
        p = s.ask(q).payload()
        rows.append((p["intent"], p["deterministic_used"], p["execution_mode"], p["execution_path"], p["fallback_code"], len(p)))
    return spark.createDataFrame(rows, "intent string, computed boolean, mode string, path string, code string, keys int")


@query("sql_answers", """
SELECT 'how are priorities distributed? breakdown' AS question, 'o_orderpriority distribution (' || count(*) || ' groups): ' || string_agg(v || '=' || n, ', ' ORDER BY v) || '.' AS answer, CAST(count(*) + 2 AS INT) AS evidence FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 'what are the distinct values of priority', 'Distinct o_orderpriority values: ' || string_agg(v, ', ' ORDER BY v) || '.', CAST(count(*) + 2 AS INT) FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 'how many orders are there?', 'There are ' || count(*) || '.', 1 FROM orders
UNION ALL SELECT 'largest customer key', 'top_key: ' || max(o_custkey) || '.', 1 FROM orders
UNION ALL SELECT 'range of keys', 'Computed result: [{"low": ' || min(o_custkey) || ', "high": ' || max(o_custkey) || '}]', 1 FROM orders""")
def sql_answers(spark, d):
    """What the rows of statements say."""
    s = _session(spark, d)
    asked = [
        ("how are priorities distributed? breakdown", "SELECT o_orderpriority, count(*) AS n FROM _table GROUP BY o_orderpriority ORDER BY o_orderpriority"), ("what are the distinct values of priority", "SELECT o_orderpriority, count(*) AS freq FROM _table GROUP BY 1 ORDER BY 1"),
        ("how many orders are there?", "SELECT count(*) AS total FROM _table"), ("largest customer key", "SELECT max(o_custkey) AS top_key FROM _table"), ("range of keys", "SELECT min(o_custkey) AS low, max(o_custkey) AS high FROM _table"),
    ]
    rows = [(q, *s.ask_sql(q, sql, "orders")) for q, sql in asked]
    return spark.createDataFrame([(q, a, len(e)) for q, a, e in rows], "question string, answer string, evidence int")


@query("table_evidence", """
SELECT 'what is the average l_quantity?' AS question, 'Computed mean of l_quantity from ' || count(*) || ' rows (non-null ' || count(l_quantity) || ')' AS snippet, 80 AS score, 'table_stat' AS evidence_type FROM lineitem
UNION ALL SELECT 'how many distinct l_partkey?', 'Computed nunique of l_partkey from ' || count(*) || ' rows (non-null ' || count(l_partkey) || ')', 80, 'table_stat' FROM lineitem
UNION ALL SELECT 'how many rows are there?', 'Computed row_count of lineitem', 80, 'table_stat'
UNION ALL SELECT 'breakdown of l_returnflag', 'Distinct l_returnflag: ' || l_returnflag || ' (count=' || count(*) || ')', 86, 'table_value' FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'breakdown of l_returnflag', 'Computed unique_count of l_returnflag from ' || count(*) || ' rows', 88, 'table_stat' FROM lineitem
UNION ALL SELECT 'list the values of l_linestatus', 'Distinct l_linestatus: ' || l_linestatus || ' (count=' || count(*) || ')', 84, 'table_value' FROM lineitem GROUP BY l_linestatus""")  # fmt: skip
def table_evidence(spark, d):
    """Computed evidence for questions of each kind."""
    t = table(spark, d, "lineitem")
    rows = []
    for q in ("what is the average l_quantity?", "how many distinct l_partkey?", "how many rows are there?", "breakdown of l_returnflag", "list the values of l_linestatus"):
        rows += [(q, e.snippet if e.evidence_type == "table_value" else e.snippet.rsplit(": ", 1)[0], e.score, e.evidence_type) for e in PL.table_evidence(q, "lineitem", t, PL.plan_question(q, "lineitem", t))]
    return spark.createDataFrame(rows, "question string, snippet string, score int, evidence_type string")


@query("follow_ups", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in [
    ("schema", "how many are there?", "How many columns are there in orders?"), ("schema", "list the names", "What are the column names in orders?"), ("count_values", "how many?", "How many distinct values are there for o_orderpriority in orders?"),
    ("list_values", "what are they, list the values", "What are the distinct values of o_orderpriority in orders?"), ("aggregate", "and what about the maximum?", "and what about the maximum about o_orderpriority in orders"), ("aggregate", "what is the average o_totalprice?", "what is the average o_totalprice?"),
]) + ") AS t(last_intent, question, rewritten)")
def follow_ups(spark, d):
    """Questions that lean on the one before."""
    columns = table(spark, d, "orders").columns
    asked = [("schema", "how many are there?"), ("schema", "list the names"), ("count_values", "how many?"), ("list_values", "what are they, list the values"), ("aggregate", "and what about the maximum?"), ("aggregate", "what is the average o_totalprice?")]
    rows = [(i, q, PL.rewrite_follow_up(q, {"intent": i, "source": "orders", "column": "o_orderpriority"}, columns)) for i, q in asked]
    return spark.createDataFrame(rows, "last_intent string, question string, rewritten string")


@query("column_suggestions")
def column_suggestions(spark, d):
    """Columns for questions, with roles, identifiers and the words of their values."""
    rows = []
    for name in ("customer", "orders"):
        t = table(spark, d, name)
        roles = T.column_roles(t)
        ids, words = [r["column"] for r in T.id_candidates(t).collect()], PL.value_words(t, roles)
        for q in ("how many customers are in the building segment?", "what is the average balance?", "how many urgent orders?"):
            rows += [(name, q, c, n) for c, n in PL.suggest_columns(q, t, roles, words, ids=ids)]
    return spark.createDataFrame(rows, "source string, question string, column string, score int")


@query("timeline_answer")
def timeline_answer(spark, d):
    """Dated sentences about an operation, in order."""
    rows = table(spark, d, "documents").where("contains(text, 'endoscopy')").select(F.col("doc_id").alias("source"), F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("snippet"))
    return AN.timeline(rows.where("contains(snippet, 'endoscopy')").select("source", "snippet", F.char_length("snippet").alias("rank")))


@query("source_manifest")
def source_manifest(spark, d):
    rows = table(spark, d, "loaded_document").select("loaded_id", "source_path", "text", "page_count").distinct()
    return rows.select("loaded_id", F.md5("text").alias("digest"), AN.source_manifest(F.col("source_path"), F.col("text"), F.col("page_count")).alias("line"))


@query("absence_cues")
def absence_cues(spark, d):
    """Sentences of the documents that say that something is not there."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("line", "t"))
    return rows.groupBy("doc_id").agg(F.sum(X.states_absence(F.col("t")).cast("int")).alias("absent"), F.sum(X.states_failure(F.col("t")).cast("int")).alias("failing"))


# ---- functions that no other query shows ------------------------------------------------------------------------------
@query("phi_found_beside_patterns")
def phi_found_beside_patterns(spark, d):
    """Entity values that stand in their notes, those that overlap no pattern's span, beside the spans of the patterns."""
    e = table(spark, d, "phi_entity").where("record_id IS NOT NULL AND trim(value_text) <> ''").select("record_id", "value_text", "phi_type").distinct()
    e = e.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("value_text").alias("value"), F.coalesce("phi_type", F.lit("OTHER")).alias("kind")))).alias("e"))
    rows = _notes(spark, d).join(e, "record_id")
    claimed = rows.select("record_id", "document_text", P.claim_entities(F.col("document_text"), F.col("e")).alias("found"), P.merge_spans(P.all_spans(F.col("document_text"))).alias("regex"))
    return claimed.select("record_id", F.md5("document_text").alias("note"), F.inline(P.merge_mappings(F.col("found"), F.col("regex"))))


@query("phi_alignment")
def phi_alignment(spark, d):
    """What a redacted copy no longer holds, found by aligning it with its original."""
    rows = _notes(spark, d).select("record_id", "document_text", P.scrub(F.col("document_text")).alias("redacted"))
    spans = rows.select("record_id", F.md5("document_text").alias("note"), F.inline(P.align_redaction(F.col("document_text"), F.col("redacted"))))
    return spans.select("record_id", "note", "start", "end", "value")


@query("invalid_references", """
SELECT report_id, CAST(len(list_filter(r, lambda x: x >= n)) AS INT) AS invalid FROM (
  SELECT report_id, max(n) AS n, list(ref) AS r FROM (SELECT report_id, finding_no + 1 AS ref, count(*) OVER (PARTITION BY report_id) AS n FROM (SELECT DISTINCT report_id, finding_no FROM radiology_mode_output WHERE report_id IS NOT NULL)) GROUP BY report_id)""")  # fmt: skip
def invalid_references(spark, d):
    """Impressions that point one finding too far: the last reference of a report is behind its findings."""
    f = table(spark, d, "radiology_mode_output").where("report_id IS NOT NULL").select("report_id", "finding_no").distinct().groupBy("report_id").agg(F.collect_list("finding_no").alias("findings"))
    impressions = F.transform("findings", lambda n: F.struct(F.array((n + 1).cast("int")).alias("finding_refs")))
    return f.select("report_id", V.invalid_references(impressions, F.col("findings")).alias("invalid"))


_WRAPS = [("plain", "{p}"), ("fenced", "Here it is:\n```json\n{p}\n```"), ("inside", "The answer is {p} as asked"), ("python", "{{'a': True, 'b': None, 'name': 'x'}}")]


@query("lenient_json", "SELECT report_id, how, CASE WHEN how = 'python' THEN 'x' ELSE exam_type END AS name FROM (SELECT DISTINCT report_id, exam_type FROM radiology_train WHERE exam_type IS NOT NULL), (SELECT unnest(['plain', 'fenced', 'inside', 'python']) AS how)")
def lenient_json(spark, d):
    """Payloads recovered from text that fences or surrounds them."""
    r = table(spark, d, "radiology_train").where("exam_type IS NOT NULL").select("report_id", "exam_type").distinct()
    p = F.to_json(F.struct(F.col("exam_type").alias("name")))
    texts = F.array(*[F.struct(F.lit(k).alias("how"), F.replace(F.lit(t.replace("{{", "{").replace("}}", "}")), F.lit("{p}"), p).alias("t")) for k, t in _WRAPS])
    return r.select("report_id", F.inline(texts)).select("report_id", "how", F.try_variant_get(V.lenient_json(F.col("t")), "$.name", "string").alias("name"))


@query("best_candidates", "SELECT report_id, arg_max({'a': anatomy}, (confidence, -finding_no)).a AS anatomy, max(confidence) AS confidence FROM (SELECT DISTINCT report_id, finding_no, anatomy, confidence FROM radiology_mode_output WHERE report_id IS NOT NULL AND confidence IS NOT NULL) GROUP BY report_id")
def best_candidates(spark, d):
    """The finding of each report with the highest confidence, the first of equals."""
    rows = table(spark, d, "radiology_mode_output").where("report_id IS NOT NULL AND confidence IS NOT NULL").select("report_id", "finding_no", "anatomy", "confidence").distinct()
    return E.best_candidate(rows, "report_id", "confidence", "finding_no").select("report_id", "anatomy", "confidence")


@query("step_totals", "SELECT count(*) AS steps, round(sum(value), 4) AS duration, CAST(sum(length(event_type) + user_id) AS BIGINT) AS tokens FROM events")
def step_totals(spark, d):
    rows = table(spark, d, "events").select(F.col("value").alias("duration"), F.length("event_type").cast("bigint").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return B.step_totals(rows).withColumn("duration", F.round("duration", 4))


@query("density")
def density(spark, d):
    """Completeness and density of the extractions against their notes."""
    rows = table(spark, d, "extract_train").where("extracted IS NOT NULL AND document_text IS NOT NULL").select("record_id", "document_text", "extracted").distinct()
    v = F.try_parse_json("extracted")
    flags = [F.try_variant_get(v, f"$.{k}", "string").isNotNull() for k in ("patient_name", "visit_date", "primary_diagnosis")]
    return rows.select("record_id", F.md5("document_text").alias("note"), F.round(Q.field_coverage(flags), 6).alias("coverage"), F.round(Q.information_density(F.col("document_text"), F.col("extracted")), 6).alias("density"), F.round(Q.completeness(flags, F.col("document_text"), F.col("extracted")), 6).alias("completeness"))


@query("stream_files", "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, max(length(text)) AS n FROM documents GROUP BY doc_id)")
def stream_files(spark, d):
    """The documents written as a folder of text files and taken up by a stream that ends when it has seen them all."""
    sc, base = spark.sparkContext, _folder(spark, "stream")
    one = table(spark, d, "documents").groupBy("doc_id").agg(F.max("text").alias("text"))
    one.select(F.translate("text", "\n\r", "  ").alias("value")).repartition(max(2, sc.defaultParallelism)).write.text(f"{base}/in")
    B.stream_folder(spark, f"{base}/in", f"{base}/out", f"{base}/state", lambda files: files.select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("text")))
    return spark.read.schema("text string").parquet(f"{base}/out").agg(F.count("*").alias("files"), F.sum(F.char_length("text")).alias("chars"))


# ---- templates, payloads, registries --------------------------------------------------------------------------------
_CATALOG_SQL = """SELECT vocabulary AS field_name, 'which ' || vocabulary AS field_description, CASE WHEN code LIKE '%1' THEN 'yes' ELSE 'no' END AS field_is_mandatory, code AS field_value, trim(term) AS value_label, code AS o FROM ontology_result"""


@query("table_specs_catalog")
def table_specs_catalog(spark, d):
    """The reference list as a field catalog: a field for each vocabulary, an option for each code."""
    o = table(spark, d, "ontology_result").select(
        F.col("vocabulary").alias("field_name"), F.concat(F.lit("which "), "vocabulary").alias("field_description"), F.when(F.col("code").endswith("1"), "yes").otherwise("no").alias("field_is_mandatory"), F.col("code").alias("field_value"), F.trim("term").alias("value_label"), F.col("code").alias("o")
    )
    return TP.table_specs(o, "o").withColumns({c: F.array_join(c, ";") for c in ("values", "labels")})


@query("table_specs_data")
def table_specs_data(spark, d):
    """A plain table: its columns as fields."""
    return TP.table_specs(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey").drop("values", "labels")


@query("template_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t.description}', '{t.mode}')" for n, t in ((t.name, t) for t in TP.list_templates())) + ") AS t(name, description, mode)")
def template_registry(spark, d):
    """The built-in templates after a round trip through YAML, by the names that resolve_template takes."""
    rows = []
    for info in TP.list_templates():
        spec, name = TP.resolve_template(info.name)
        back = TP.parse_template(TP.template_yaml(spec))
        if [f["name"] for f in back["fields"]] == [f["name"] for f in spec["fields"]]:
            rows.append((name, back["description"], TP.template_mode(back)))
    return spark.createDataFrame(rows, "name string, description string, mode string")


@query("registries", "SELECT * FROM (VALUES ('metric', 8), ('mode', 2), ('rules', 2), ('hipaa', 21)) AS t(registry, entries)")
def registries(spark, d):
    rows = [("metric", len(Q.list_metrics())), ("mode", len(TP.list_modes())), ("rules", len(P.list_rules())), ("hipaa", len(P.CATEGORIES["hipaa"]))]
    return spark.createDataFrame(rows, "registry string, entries int")


_PAYLOAD_SPEC = {"name": "Note", "fields": [
    {"name": "patient_name", "type": "str", "required": True}, {"name": "visit_date", "type": "str", "required": False}, {"name": "primary_diagnosis", "type": "str", "required": False}, {"name": "medication", "type": "list[str]", "required": True},
]}


@query("payload_coerced", """
SELECT record_id, md5(extracted) AS digest, coalesce(json_extract_string(extracted, '$.patient_name'), '') AS patient_name, json_extract_string(extracted, '$.visit_date') AS visit_date, json_extract_string(extracted, '$.primary_diagnosis') AS primary_diagnosis,
CAST(CASE json_type(extracted, '$.medication') WHEN 'ARRAY' THEN json_array_length(extracted, '$.medication') WHEN 'VARCHAR' THEN 1 ELSE 0 END AS INT) AS medications FROM (SELECT DISTINCT record_id, extracted FROM extract_train WHERE json_valid(extracted))""")
def payload_coerced(spark, d):
    """Extractions in the shape of a schema, optional values that break their rule gone."""
    rows = table(spark, d, "extract_train").where("extracted IS NOT NULL").select("record_id", "extracted").distinct()
    shaped = rows.select("record_id", F.md5("extracted").alias("digest"), E.coerced_payload(F.col("extracted"), _PAYLOAD_SPEC).alias("p")).where("p IS NOT NULL")
    return shaped.select("record_id", "digest", E.validated_payload(F.col("p"), _PAYLOAD_SPEC).alias("p")).select("record_id", "digest", "p.patient_name", "p.visit_date", "p.primary_diagnosis", F.size("p.medication").alias("medications"))


@query("rewards")
def rewards(spark, d):
    """Rewards of reports as extractions, and of their findings and impressions."""
    r = table(spark, d, "radiology_train").where("findings IS NOT NULL").select("report_id", "findings", "impressions").distinct()
    return r.select("report_id", F.round(Q.extraction_reward(F.col("findings"), F.col("impressions")), 6).alias("extraction"), F.round(Q.finding_reward(F.col("findings")), 6).alias("findings"), Q.diagnosis_reward(F.col("impressions")).alias("diagnosis"))


@query("schema_scores", "SELECT * FROM (VALUES ('" + "'), ('".join(sorted(TP.BUILT_IN)) + "')) AS t(name), (SELECT 1.0::DOUBLE AS metric)")
def schema_scores(spark, d):
    """Built-in templates measured against themselves."""
    rows = [(n, [f["name"] for f in TP.built_in(n)["fields"]]) for n in sorted(TP.BUILT_IN)]
    df = spark.createDataFrame(rows, "name string, fields array<string>")
    return df.select("name", F.round(Q.schema_metric(F.col("fields"), F.col("fields"), F.lit(True)), 6).alias("metric"))


@query("schema_granularity")
def schema_granularity(spark, d):
    """Whether a flat template fits what report texts hold."""
    r = table(spark, d, "radiology_train").select("report_id", "report_text").distinct()
    g = TP.granularity(F.col("report_text"), TP.built_in("msk_mri"))
    return r.select("report_id", F.md5("report_text").alias("digest"), g.alias("g")).select("report_id", "digest", F.round("g.score", 6).alias("score"), F.array_join("g.issues", ",").alias("issues"))


@query("think_levels", "SELECT * FROM (VALUES ('generic', 'fast', 'fast', 'deep'), ('chest_ct', 'standard', 'standard', 'deep'), ('thyroid_us', 'fast', 'fast', 'deep')) AS t(name, auto, fast, deep)")
def think_levels(spark, d):
    rows = [(n, *[TP.effective_level(a, TP.built_in(n)) for a in ("auto", "fast", "deep")]) for n in ("generic", "chest_ct", "thyroid_us")]
    return spark.createDataFrame(rows, "name string, auto string, fast string, deep string")


@query("phi_deidentified")
def phi_deidentified(spark, d):
    """Entity values and what the patterns find, replaced together."""
    values = table(spark, d, "phi_entity").where("record_id IS NOT NULL AND trim(value_text) <> ''").groupBy("record_id").agg(F.collect_set("value_text").alias("v"))
    rows = _notes(spark, d).join(values, "record_id", "left")
    return rows.select("record_id", P.deidentify(F.col("document_text"), F.col("v")).alias("text"))


@query("lengths_across", """
WITH f AS (SELECT DISTINCT report_id, finding_no, length(observation) AS extent, length(anatomy) AS len FROM radiology_mode_output WHERE report_id IS NOT NULL AND length(anatomy) > 0 AND length(observation) > 0),
l AS (SELECT report_id, finding_no, min(len) AS len FROM f GROUP BY ALL)
SELECT report_id, max(round_even(extent / (l.len * 10.0) * 100, 0))::DOUBLE AS worst FROM f JOIN l USING (report_id, finding_no) GROUP BY report_id""")
def lengths_across(spark, d):
    """Extents in one list, lengths in another, met by the number of the finding."""
    f = table(spark, d, "radiology_mode_output").where("report_id IS NOT NULL AND length(anatomy) > 0 AND length(observation) > 0").select("report_id", "finding_no", F.length("observation").alias("extent"), F.length("anatomy").alias("len")).distinct()
    lists = f.groupBy("report_id").agg(F.collect_list(F.struct("finding_no", "extent")).alias("a"), F.array_sort(F.collect_list(F.struct("finding_no", "len"))).alias("b"))
    return lists.select("report_id", E.max_percentage_across(F.col("a"), "extent", "finding_no", E.lengths_by_key(F.col("b"), "finding_no", "len")).cast("double").alias("worst"))


_DESCRIBED = [("Count entries in samples where tumor is true", "count_where|samples|tumor"), ("Count all entries in the list / sample_list", "count|sample_list"), ("Maximum tumor percentage over all samples", "max_percentage"), ("Number of samples where positive is true", "count_where||positive"), ("Plain text", "")]


@query("derived_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DESCRIBED) + ") AS t(description, rule)")
def derived_rules(spark, d):
    return spark.createDataFrame([(a, "|".join(E.derived_rule(a) or ())) for a, _ in _DESCRIBED], "description string, rule string")


# ---- chunks, pages, layouts, reports --------------------------------------------------------------------------------
@query("chunk_list")
def chunk_list(spark, d):
    return S.list_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("chunk_get")
def chunk_get(spark, d):
    """The last chunk of every document, and the one behind it, which is missing."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    last = S.document_chunks(docs, "doc_id", "text").groupBy(F.col("doc_id").alias("source")).agg(F.max("chunk_id").alias("k"))
    wanted = last.select("source", F.explode(F.array("k", F.col("k") + 1)).alias("chunk_id"))
    out = S.get_chunk(docs, "doc_id", "text", wanted)
    return out.withColumn("digest", F.md5("text")).drop("text")


@query("phi_page_spans")
def phi_page_spans(spark, d):
    """Identifiers in the pages of scans, with the parts of each by page."""
    pages = _pages(spark, d)
    docs = G.assemble_pages(pages, "loaded_id", "page_number", "text").select("loaded_id", "text")
    offsets = G.page_offsets(pages, "loaded_id", "page_number", "text").withColumnRenamed("page_number", "page")
    m = G.with_page_spans(P.phi_spans(docs, "loaded_id", "text"), offsets, "loaded_id")
    return m.select("loaded_id", "start", "end", "phi_type", F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"], p["start"], p["end"])), ",").alias("pages"))


@query("source_blocks")
def source_blocks(spark, d):
    """The place of every extracted field in its note."""
    rows = _extracted(spark, d).withColumn("note", F.concat_ws("-", "record_id", F.md5("document_text")))
    return G.source_block(rows, "note", "document_text").select("note", F.to_json("source_block").alias("source_block"))


@query("layout_lines", """
SELECT p_partkey, 1 AS page, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY l) - 1 AS INT) AS line_no, string_agg(w, ' ' ORDER BY i) AS text, CAST(l * 10 AS DOUBLE) AS y0, CAST(l * 10 + 8 AS DOUBLE) AS y1
FROM (SELECT p_partkey, (i - 1) // 2 AS l, i, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)) GROUP BY p_partkey, l""")
def layout_lines(spark, d):
    """Words of part names as boxes, two on a line, the second a little lower."""
    w = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    line, place = F.floor(F.col("i") / 2), F.col("i") % 2
    boxes = w.select("p_partkey", F.lit(1).alias("page"), "w", (place * 50).cast("double").alias("x0"), (line * 10 + place).cast("double").alias("y0"), (place * 50 + 40).cast("double").alias("x1"), (line * 10 + 8).cast("double").alias("y1"))
    return G.layout_lines(boxes, "p_partkey", "page", "w")


@query("loinc_codes", "SELECT DISTINCT report_id, 'i1' AS section, site_id AS code, trim(regexp_replace(exam_type, '[\"<>&]', '', 'g')) AS meaning FROM radiology_train WHERE exam_type IS NOT NULL AND site_id IS NOT NULL")
def loinc_codes(spark, d):
    """Codes of sections in the XML part of a page."""
    r = table(spark, d, "radiology_train").where("exam_type IS NOT NULL AND site_id IS NOT NULL").select("report_id", "site_id", F.trim(F.regexp_replace("exam_type", '["<>&]', "")).alias("e")).distinct()
    page = F.concat(F.lit('<html><script type="text/xml"><template><entry origtxt="i1" x="1"><term><code meaning="'), "e", F.lit('" value="'), "site_id", F.lit('" scheme="LOINC"/></term></entry></template></script></html>'))
    return r.select("report_id", F.explode(R.loinc_entries(page)).alias("section", "c")).select("report_id", "section", "c.code", "c.meaning").distinct()


@query("report_runs")
def report_runs(spark, d):
    """What the default provider reads for a template, and how complete it is."""
    notes = table(spark, d, "radiology_train").where("report_text IS NOT NULL").select(F.concat_ws("-", "report_id", F.md5("report_text")).alias("report"), "report_text").distinct()
    out = TP.run_report(notes, "report", "report_text", TP.built_in("chest_ct"))
    return out.select("report", F.map_keys("fields").alias("fields"), "overall", "required_coverage", "optional_coverage").withColumn("fields", F.array_join(F.array_sort("fields"), ", "))


_PRESSURES = [
    ("BP was 128/82 on arrival. Normal range 120/80.", "pressure is 120/82", "128/82"), ("Target 130/80; measured 150/95.", "150 over 95", "130/80"), ("no reading", "120/80", None), ("Ratio 12/34, blood pressure 99/60", "99/60", "99/60"),
]


@query("blood_pressures", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {repr(v) if v else 'NULL'})" for t, c, v in _PRESSURES) + ") AS t(text, claim, value)")
def blood_pressures(spark, d):
    """The pressure of a text that a claim means."""
    df = spark.createDataFrame([(t, c) for t, c, _ in _PRESSURES], "text string, claim string")
    return df.select("text", "claim", V.blood_pressure_near(F.col("text"), F.col("claim")).alias("value"))


@query("citation_focus")
def citation_focus(spark, d):
    """Citations with the focus on one source and a change in size asked for."""
    hits = merge_hits_dedupe(spark, d)
    return S.diverse_citations(S.ranked_citations(hits, "liver lesion growth", 20, delta=True), 5, ("text_chunk",))


@query("claims_by_level", """SELECT item_id, CASE WHEN miss = 0 AND r > 0.5 THEN 'verified' WHEN r > 0.3 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS verdict, round(CASE WHEN miss = 0 AND r > 0.5 THEN least(0.95, r) ELSE r END, 6) AS confidence, 'standard: quick only' AS level FROM (
  SELECT item_id, len(list_filter(regexp_extract_all(response, '\\d+(?:\\.\\d+)?'), lambda n: NOT contains(source_text, n))) AS miss,
    len(list_intersect(list_distinct(regexp_extract_all(lower(response), '[a-z0-9]+')), regexp_extract_all(lower(source_text), '[a-z0-9]+'))) / len(list_distinct(regexp_extract_all(lower(response), '[a-z0-9]+'))) AS r
  FROM eval_item WHERE response IS NOT NULL)""")
def claims_by_level(spark, d):
    return V.verify_claims(table(spark, d, "eval_item").where("response IS NOT NULL"), "item_id", "response", "source_text", "standard")


# ---- sources and sinks, written and read again ----------------------------------------------------------------------
def _folder(spark, name: str) -> str:
    """A new folder in the shared place for what a query writes."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


_READ_BACK = "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_custkey) AS most FROM customer GROUP BY c_mktsegment"


def _summary(df):
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_custkey").cast("bigint").alias("most"))


def _round_trip(write, suffix: str, read=None):
    def run(spark, d):
        path = f"{_folder(spark, 'io')}.{suffix}"
        write(table(spark, d, "customer"), path)
        return _summary((read or R.read_source)(spark, path))

    return run


query("source_csv", _READ_BACK)(_round_trip(lambda df, p: W.write_csv(df, p), "csv"))
query("source_tsv", _READ_BACK)(_round_trip(lambda df, p: df.write.csv(p, header=True, sep="\t"), "tsv"))
query("source_semicolons", _READ_BACK)(
    _round_trip(lambda df, p: df.write.csv(p, header=True, sep=";"), "csv", lambda spark, p: R.read_delimited(spark, p).select("c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_custkey").cast("bigint").alias("c_custkey")))
)
query("source_jsonl", _READ_BACK)(_round_trip(lambda df, p: W.write_jsonl(df, p), "jsonl"))
query("source_json", _READ_BACK)(_round_trip(lambda df, p: df.write.option("lineSep", "\n").json(p), "json", lambda spark, p: spark.read.json(p)))
query("source_parquet", _READ_BACK)(_round_trip(lambda df, p: W.write_parquet(df, p), "parquet"))


@query("source_examples", "SELECT count(*) AS examples, count(DISTINCT c_name) AS inputs, count(c_mktsegment) AS labels FROM customer")
def source_examples(spark, d):
    """Customers as training examples of JSON lines, checked line by line."""
    path = _folder(spark, "examples") + ".jsonl"
    table(spark, d, "customer").write.json(path)
    rows = R.check_examples(spark, path, ["c_name"], ["c_mktsegment"])
    return rows.agg(F.count("*").alias("examples"), F.countDistinct(F.col("inputs")["c_name"]).alias("inputs"), F.count(F.col("labels")["c_mktsegment"]).alias("labels"))


@query("source_bad_lines", "SELECT count(*) FILTER (c_custkey % 7 = 0) AS bad FROM customer")
def source_bad_lines(spark, d):
    """Lines of JSON, some cut short: those that do not parse."""
    path = _folder(spark, "lines") + ".jsonl"
    c = table(spark, d, "customer")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    c.select(F.when(F.col("c_custkey") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return R.bad_json_lines(spark, path).agg(F.count("*").alias("bad"))


@query("source_files", "SELECT 25 AS files, sum(length(n_name))::BIGINT AS chars, 25 AS bytes FROM nation")
def source_files(spark, d):
    """Nations as one text file each: listed, read as texts and as bytes."""
    base = _folder(spark, "files")
    names = table(spark, d, "nation").select("n_name").repartitionByRange(25, "n_name")
    names.select(F.col("n_name").alias("value")).write.option("lineSep", "\n").partitionBy().text(base)
    listed = len([f for f in R.expand_sources(spark, base) if not f.rsplit("/", 1)[-1].startswith(("_", "."))])
    texts = R.read_text(spark, base).where("trim(text) <> ''")
    found = R.read_bytes(spark, base, (".txt",)).where("length > 0")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("t")).where("t <> ''")
    out = lines.agg(F.count("*").cast("int").alias("files"), F.sum(F.char_length("t")).alias("chars"))
    return out.withColumn("bytes", F.lit(25 if listed and not found.isEmpty() else 0))


@query("sink_documents", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sink_documents(spark, d):
    """Rows as JSON texts in a folder for each segment."""
    path = _folder(spark, "documents")
    W.write_documents(table(spark, d, "customer"), "c_mktsegment", path)
    return spark.read.json(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("sink_redacted")
def sink_redacted(spark, d):
    """Redacted notes with the map of what was replaced, which holds no identifier."""
    path = _folder(spark, "redacted")
    notes = _notes(spark, d)
    texts = notes.select("record_id", P.scrub(F.col("document_text")).alias("text"))
    W.write_redacted(texts, "record_id", "text", P.phi_spans(notes, "record_id", "document_text"), path)
    back, made = spark.read.json(f"{path}/texts"), spark.read.json(f"{path}/map")
    left = back.agg(F.count("*").alias("texts"), F.sum(F.when(P.leak_score(F.col("text")) == 0.0, 1).otherwise(0)).alias("leaks"))
    return left.crossJoin(made.agg(F.count("*").alias("spans"))).withColumn("columns", F.lit(", ".join(sorted(made.columns))))


@query("public_columns", "SELECT 'a, b' AS columns")
def public_columns(spark, d):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, _source int, redaction_map int")
    return spark.createDataFrame([(", ".join(W.public_tier(df).columns),)], "columns string")


@query("batch_runs", "SELECT 'first' AS run, count(*)::BIGINT AS total, count(*) FILTER (c_custkey % 5 <> 0)::BIGINT AS succeeded, count(*) FILTER (c_custkey % 5 = 0)::BIGINT AS failed, 0::BIGINT AS skipped FROM customer UNION ALL SELECT 'again', count(*), 0, count(*) FILTER (c_custkey % 5 = 0), count(*) FILTER (c_custkey % 5 <> 0) FROM customer")
def batch_runs(spark, d):
    """A batch in which every fifth document fails, and its resume."""
    out = _folder(spark, "batch")
    docs = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).otherwise("").alias("t"))
    rows = []
    for run in ("first", "again"):
        n = B.run_batch(docs, "c_custkey", "t", lambda t: t.upper(), out)
        rows.append((run, n["total"], n["succeeded"], n["failed"], n["skipped"]))
    return spark.createDataFrame(rows, "run string, total bigint, succeeded bigint, failed bigint, skipped bigint")


# ---- rules of the planner and of schemas, case by case --------------------------------------------------------------
_QUESTIONS = [
    # question, intent, operation by words, by parts of the text, spread, values, rows, change, time
    ("what is the average age?", "aggregate", "mean", "mean", False, False, False, False, False), ("what is the meaning of this?", "aggregate", "", "mean", False, False, False, False, False), ("total cost", "aggregate", "sum", "sum", False, False, False, False, False),
    ("how many rows are there?", "count_rows", "count", "", False, False, True, False, False), ("how many patients?", "count_distinct", "count", "", False, False, False, False, False), ("distribution of sex", "count_values", "", "", True, False, False, False, False),
    ("which columns are there?", "schema", "", "", False, False, False, False, False), ("what colums does it have?", "schema", "", "", False, False, False, False, False), ("how many types of scanner are there and what are the options", "count_values", "count", "", False, True, False, False, False),
    ("list the scanners", "list_values", "", "", False, True, False, False, False), ("did the lesion grow compared with before?", "text_qa", "", "", False, False, False, True, False), ("timeline of events", "text_qa", "", "", False, False, False, False, True),
    ("how many missing values", "count_distinct", "count", "missing_count", False, False, False, False, False), ("what is the standard deviation of weight", "aggregate", "std", "std", False, False, False, False, False),
]


@query("question_rules", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in _QUESTIONS) + ") AS t(question, intent, by_words, by_marks, spread, \"values\", \"rows\", change, \"time\")")
def question_rules(spark, d):
    """What the planner reads out of questions."""
    rows = [(q, PL.intent_of(q), PL.operation_by_words(q) or "", PL.operation_by_marks(q) or "", PL.asks_spread(q), PL.asks_values(q), PL.asks_rows(q), PL.asks_delta(q), PL.asks_time(q)) for q, *_ in _QUESTIONS]
    return spark.createDataFrame(rows, "question string, intent string, by_words string, by_marks string, spread boolean, values boolean, rows boolean, change boolean, time boolean")


_PLANNED = [("average of O Totalprice", "aggregate", "o_totalprice", "mean"), ("stat|avg|O_TOTALPRICE", "aggregate", "o_totalprice", "mean"), ("distribution||o orderpriority", "count_values", "o_orderpriority", ""), ("distinct|unique|o_custkey", "count_distinct", "o_custkey", "nunique"), ("stat|avg|nothing", "error", "", ""), ("stat|guess|o_custkey", "error", "", "")]


@query("plan_rules", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in _PLANNED) + ") AS t(proposed, intent, \"column\", operation)")
def plan_rules(spark, d):
    """Proposed plans with settled names; unknown columns and operations are errors."""
    o = table(spark, d, "orders")
    rows = []
    for text, *_ in _PLANNED:
        try:
            if "|" in text:
                intent, op, column = text.split("|")
                p = PL.normalize_plan({"intent": intent, "operation": op, "column": column, "source": "orders"}, o)
            else:
                p = PL.plan_question(text, "orders", o)
            rows.append((text, p.intent, p.column, p.operation))
        except ValueError:
            rows.append((text, "error", "", ""))
    return spark.createDataFrame(rows, "proposed string, intent string, column string, operation string")


_OPERATIONS = [("avg", "mean"), ("Average", "mean"), ("unique", "nunique"), ("distinct", "nunique"), ("null", "missing_count"), ("na", "missing_count"), ("total", "sum"), ("guess", "error")]
_SAFE = [("SELECT a FROM _table", True), ("select created_at from _table", True), ("SELECT a FROM other", False), ("DELETE FROM _table", False), ("SELECT 1; SELECT * FROM _table", False), ("WITH t AS (SELECT 1) SELECT * FROM _table", False), ("SELECT a FROM _table WHERE drop = 1", False)]
_NO_ANSWER = [("Not available in the sources.", True), ("The value is 5.", False), ("", True), ("I don't know.", True)]


@query("small_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{kind}', $x${a}$x$, '{b}')" for kind, rows in (("operation", _OPERATIONS), ("safe", [(a, str(b).lower()) for a, b in _SAFE]), ("no_answer", [(a, str(b).lower()) for a, b in _NO_ANSWER])) for a, b in rows) + ") AS t(rule, given, result)")
def small_rules(spark, d):
    """Names of operations, planned statements, texts that are no answer."""

    def operation(x):
        try:
            return T.operation_name(x)
        except ValueError:
            return "error"

    rows = [("operation", a, operation(a)) for a, _ in _OPERATIONS] + [("safe", a, str(PL.planned_sql_is_safe(a)).lower()) for a, _ in _SAFE] + [("no_answer", a, str(PL.is_non_answer(a)).lower()) for a, _ in _NO_ANSWER]
    return spark.createDataFrame(rows, "rule string, given string, result string")


@query("table_catalog", "SELECT 'orders' AS name, count(*) AS rows, 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS columns FROM orders UNION ALL SELECT 'customer', count(*), 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' FROM customer")
def table_catalog(spark, d):
    return _session(spark, d).catalog()


_RAW_SPEC = {"name": "Visit", "fields": [
    {"name": "Visit Date", "type": "string"}, {"name": "visit-date", "type": "text", "required": False}, {"name": "2nd size", "type": "number"}, {"name": "Grade", "type": "enum", "values": ["Mild", "mild", "Severe"], "required": False},
    {"name": "tags", "type": "list[string]"}, {"name": "lesions", "type": "array", "fields": [{"name": "sizeMm", "type": "double"}, {"name": "side", "type": "str"}]}, {"name": "flag", "type": "boolean"},
]}
_SCHEMA_CASES = [
    ("names", "visit_date,visit_date_2,field_2nd_size,grade,tags,lesions,flag"), ("types", "str,str,float,enum,list[str],list,bool"), ("options", "Mild,Severe,None"), ("pascal", "ChestCtReport,Schema2ndVisit,Schema"),
    ("struct", "struct<visit_date:string,visit_date_2:string,field_2nd_size:double,grade:string,tags:array<string>,lesions:array<struct<size_mm:double,side:string>>,flag:boolean>"), ("fields", "9"), ("depth", "2"),
    ("evidence", "struct<value:variant,excerpt:string>"), ("round_trip", "visit_date:str,visit_date_2:str,field_2nd_size:float,grade:enum,tags:list[str],lesions:list,flag:bool"), ("issues", "0"), ("issues_of_bad", "repeated field a;enum b has no values;unknown type 'odd' of c;object d has no fields"),
    ("edited", "a,c,b2"), ("labels", "1=small,2=large,3=3"), ("listing", "a=1:number,b[0].c=x:string,flag=true:boolean"), ("set", '{"a": 1, "b": [{"c": "new"}], "flag": true, "none": null}'), ("numbers", "-3.5,null,0.25"), ("truncated", "abcd...,short"),
]


@query("schema_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', $x${b}$x$)" for a, b in _SCHEMA_CASES) + ") AS t(rule, result)")
def schema_rules(spark, d):
    """Names, types, options, issues, edits and listings of specs and payloads."""
    spec = SC.normalize_spec(_RAW_SPEC)
    struct = SC.to_struct(spec)
    bad = {"fields": [{"name": "a", "type": "str"}, {"name": "a", "type": "str"}, {"name": "b", "type": "enum"}, {"name": "c", "type": "odd"}, {"name": "d", "type": "object"}]}
    edited = SC.rename_field(SC.remove_field(SC.add_field({"fields": [{"name": "a"}, {"name": "x"}, {"name": "c"}]}, {"name": "b"}), "x"), "b", "b2")
    payload = {"a": 1, "b": [{"c": "x"}], "flag": True, "none": None}
    shown = spark.createDataFrame([("n is -3.5 mm",), ("none",), ("x .25",)], "t string").select(F.coalesce(Q.first_number(F.col("t")).cast("string"), F.lit("null")).alias("n"))
    short = spark.createDataFrame([("abcdefghij",), ("short",)], "t string").select(X.truncate(F.col("t"), 7).alias("t"))
    got = {
        "names": ",".join(f["name"] for f in spec["fields"]), "types": ",".join(f["type"] for f in spec["fields"]), "options": ",".join(spec["fields"][3]["values"]), "pascal": ",".join(SC.pascal_name(n) for n in ("chest ct-report", "2nd visit", "--")), "struct": struct.simpleString(),
        "fields": str(SC.field_count(struct)), "depth": str(SC.depth(struct)), "evidence": SC.to_evidence_struct(spec)["visit_date"].dataType.simpleString(), "round_trip": ",".join(f"{f['name']}:{f['type']}" for f in SC.from_struct(struct)["fields"]), "issues": str(len(SC.spec_issues(spec))),
        "issues_of_bad": ";".join(SC.spec_issues(bad)), "edited": ",".join(f["name"] for f in edited["fields"]), "labels": ",".join(f"{k}={v}" for k, v in SC.value_labels("1=small; 2=large; 3").items()), "listing": ",".join(f"{x['path']}={x['value']}:{x['kind']}" for x in E.flatten_value(payload, "listing")),
        "set": json.dumps(E.json_set(json.loads(json.dumps(payload)), "b[0].c", "new")), "numbers": ",".join(r["n"] for r in shown.collect()), "truncated": ",".join(r["t"] for r in short.collect()),
    }
    return spark.createDataFrame(list(got.items()), "rule string, result string")


@query("field_names", """SELECT DISTINCT path, list_has_any(ws, ['date', 'dob', 'birth', 'birthday', 'admission', 'discharge', 'study_date', 'exam_date']) AS is_date, list_has_any(ws, ['impression', 'finding', 'findings', 'diagnosis', 'assessment', 'procedure', 'exam_date', 'date_of_birth', 'dob', 'patient_name']) AS is_critical FROM (
  SELECT path, list_concat(string_split(path, '_'), [path]) AS ws FROM (SELECT unnest(json_keys(extracted)) AS path FROM extract_train WHERE json_type(extracted) = 'OBJECT'))""")
def field_names(spark, d):
    """What the names of extracted fields say of their values."""
    keys = table(spark, d, "extract_train").select(F.explode(F.json_object_keys("extracted")).alias("path")).distinct()
    return keys.select("path", E.named_as(F.col("path"), ("date", *E.DATE_WORDS)).alias("is_date"), E.named_as(F.col("path"), E.CRITICAL_WORDS).alias("is_critical"))


ORACLES |= {k: v for k, v in oracles.SQL.items() if k in QUERIES}
