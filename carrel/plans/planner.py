"""Questions over tables: intent, plan, DataFrame, answer.

The planner is plain Python over column names and a profile; what it returns is a small plan that compiles to a DataFrame, so
nothing is read before the answer is asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from difflib import get_close_matches

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.text import SEARCH_STOPWORDS, question_terms, stem_word
from carrel.operators import tables as tb
from carrel.plans import answers as an
from carrel.plans.answers import shown_number
from carrel.plans.guard import guarded_sql, planned_sql_is_safe

# Words that ask for an operation; the first list by words, the second by parts of the text, in this order.
OPERATION_WORDS = {
    "mean": {"mean", "average", "avg"}, "median": {"median"}, "min": {"min", "minimum", "lowest", "smallest"}, "max": {"max", "maximum", "highest", "largest"}, "sum": {"sum", "total"}, "std": {"std", "stdev", "standard", "deviation"},
    "count": {"count", "rows", "row", "many", "number", "total"}, "nunique": {"distinct", "unique"}, "missing_count": {"missing", "null", "na", "nan"},
}
OPERATION_MARKS = [("mean", ("average", "mean", "avg")), ("median", ("median",)), ("std", ("standard deviation", "std")), ("min", ("minimum", "lowest", "smallest")), ("max", ("maximum", "highest", "largest")), ("sum", ("sum of", "total")), ("missing_count", ("missing", "null"))]
ROW_WORDS = {"row", "record", "entry", "observation", "sample"}
SPREAD_WORDS = {"distribution", "breakdown", "split"}
VALUE_MARKS = ("what values", "which values", "list the", "what are the", "distinct values", "unique values", "categories", "options", "types of")
COUNT_MARKS = ("how many", "number of", "count of", "count the")
SCHEMA_MARKS = ("what columns", "which columns", "column names", "list columns", "list the columns", "schema", "how many columns", "what fields", "which fields", "variables are", "headers")
NO_ANSWERS = ("not available", "cannot be determined", "unable to", "no information", "not provided", "i don't know", "not found", "insufficient")
DELTA_MARKS = ("change", "difference", "grow", "grew", "shrink", "shrunk", "increase", "decrease", "delta", "compared")
TIME_MARKS = ("when", "timeline", "over time", "history of", "chronolog", "progress")


@dataclass(frozen=True)
class Plan:
    """What to compute over one table."""

    intent: str  # aggregate, count_rows, count_distinct, list_values, count_values, schema, text_qa
    source: str = ""
    column: str = ""
    operation: str = ""
    include_values: bool = False
    where: str = ""
    group_by: str = ""
    limit: int = 20


def operation_by_words(question: str) -> str | None:
    """The operation asked for, by whole words; 'total' is a sum before it is a count."""
    words = {stem_word(w) for w in re.findall("[a-z0-9]+", question.lower())} | set(re.findall("[a-z0-9]+", question.lower()))
    return next((op for op, names in OPERATION_WORDS.items() if words & names), None)


def operation_by_marks(question: str) -> str | None:
    """The operation asked for, by parts of the text (so 'meaning' holds 'mean')."""
    low = question.lower()
    return next((op for op, marks in OPERATION_MARKS if any(m in low for m in marks)), None)


def asks_schema(question: str) -> bool:
    low = question.lower()
    if any(m in low for m in SCHEMA_MARKS):
        return True
    words = re.findall("[a-z]+", low)
    near = any(get_close_matches(w, ["column", "columns"], 1, 0.8) for w in words)
    return near and any(w in words for w in ("what", "which", "list", "many", "show", "names"))


def asks_rows(question: str) -> bool:
    words = {stem_word(w) for w in re.findall("[a-z]+", question.lower())}
    return bool(words & ROW_WORDS) and any(m in question.lower() for m in COUNT_MARKS)


def asks_values(question: str) -> bool:
    return any(m in question.lower() for m in VALUE_MARKS)


def asks_spread(question: str) -> bool:
    return bool(set(re.findall("[a-z]+", question.lower())) & SPREAD_WORDS)


def asks_delta(question: str) -> bool:
    return any(m in question.lower() for m in DELTA_MARKS)


def asks_time(question: str) -> bool:
    return any(m in question.lower() for m in TIME_MARKS)


def is_non_answer(text: str) -> bool:
    low = text.lower().strip()
    return not low or any(m in low for m in NO_ANSWERS)


def intent_of(question: str) -> str:
    """schema, then spread, then count with values, count, aggregate, text - in this order."""
    low = question.lower()
    counts = any(m in low for m in COUNT_MARKS)
    if asks_schema(question):
        return "schema"
    if asks_spread(question):
        return "count_values"
    if counts and asks_values(question):
        return "count_values"
    if counts:
        return "count_rows" if asks_rows(question) else "count_distinct"
    if operation_by_marks(question):
        return "aggregate"
    if asks_values(question):
        return "list_values"
    return "text_qa"


def named_column(question: str, columns: list[str]) -> str | None:
    """The column whose name stands in the question, or all of whose (at most four) words do; the longest of several."""
    low = question.lower()
    words = set(question_terms(question, expand=False)) | {stem_word(w) for w in re.findall("[a-z0-9]+", low)}
    hits = []
    for c in columns:
        parts = [stem_word(p) for p in re.findall("[a-z0-9]+", c.lower())]
        bare = [p for p in parts if len(p) > 1]
        if c.lower() in low:
            hits.append((3, len(c), c))
        elif bare and len(bare) <= 4 and set(bare) <= words:
            hits.append((2, len(c), c))
    return max(hits)[2] if hits else None


def value_words(df: DataFrame, roles: dict[str, str], most: int = 300) -> dict[str, set[str]]:
    """The words of the `most` most frequent values of each categorical or boolean column."""
    out = {}
    for c, role in roles.items():
        if role in ("categorical", "boolean") and not isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)):
            rows = df.where(tb.quoted(c).isNotNull()).groupBy(tb.quoted(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect()
            out[c] = {w for r in rows for w in question_terms(r["v"] or "", expand=False)}
    return out


def suggest_columns(
    question: str, df: DataFrame, roles: dict[str, str] | None = None, values: dict[str, set[str]] | None = None, top_k: int = 8, ids: list[str] | None = None
) -> list[tuple[str, int]]:
    """(column, score) best first, equals in the order of the table.

    25 for each word of the name, 12 for each term inside it, 18 for each word among its values; 20 more for a numeric column
    where a statistic is asked for, 35 for an identifier where things are counted, 10 for one where values are.
    """
    wanted = set(question_terms(question))
    op = operation_by_words(question)
    out = []
    for k, c in enumerate(df.columns):
        key = tb.column_key(c)
        base = 25 * len({t for t in key.split("_") if t} & wanted) + 12 * sum(t in key for t in wanted) + 18 * len(wanted & (values or {}).get(c, set()))
        score = base + (20 if op in STATISTICS and (roles or {}).get(c) == "numeric" else 0)
        if counts_entities(question) and c in (ids or ()):
            score += 35
        elif op in ("nunique", "count") and c in (ids or ()) and base:
            score += 10
        if score > 0:
            out.append((c, score, k))
    return [(c, n) for c, n, _ in sorted(out, key=lambda x: (-x[1], x[2]))[: max(1, top_k)]]


# Operations that need numbers.
STATISTICS = {"mean", "median", "min", "max", "sum", "std"}


def counts_entities(question: str) -> bool:
    """Whether things such as subjects or patients are to be counted."""
    low = question.lower()
    return any(m in low for m in COUNT_MARKS) and bool({stem_word(w) for w in re.findall("[a-z]+", low)} & tb.ENTITY_WORDS)


def choose_column(question: str, df: DataFrame) -> str | None:
    """The column with the best score, the first of equals: 120 if its name stands in the terms of the question, 60 if it is
    one of them, 15 for each word they share."""
    terms = [t for t in question_terms(question, expand=False) if t not in SEARCH_STOPWORDS]
    if not terms:
        return None
    wanted = question_terms(question)
    joined = "_".join(wanted)
    best: tuple[int, str] | None = None
    for c in df.columns:
        key = tb.column_key(c)
        parts = {stem_word(t) for t in key.split("_") if t} | {t for t in key.split("_") if t}
        score = (120 if key and key in joined else 0) + 15 * len(parts & set(wanted)) + (60 if key in wanted else 0)
        if score and (best is None or score > best[0]):
            best = (score, c)
    return best[1] if best else None


def counts_distinct(question: str, column: str, ids: list[str], role: str, uniques: int, non_null: int) -> bool:
    """Whether a count over a column means its different values: it is named, identifies what is counted, or has few values."""
    low = question.lower()
    if set(re.findall("[a-z]+", low)) & {"distinct", "unique", "different"}:
        return True
    named = bool(set(question_terms(question)) & set(question_terms(column.replace("_", " "), expand=False)))
    if "how many" in low and named or counts_entities(question) and column in ids:
        return True
    return "how many" in low and not asks_rows(question) and role in ("categorical", "boolean") and uniques <= 20 and non_null > 0 and uniques / non_null <= 0.6


def plan_question(question: str, source: str, df: DataFrame, roles: dict[str, str] | None = None, ids: list[str] | None = None, profile: dict[str, tuple[int, int]] | None = None) -> Plan:
    """The plan of a question over one table.

    A count turns into a distinct count for a named column, an identifier of the things counted ('how many subjects') or a
    column of few values. profile: (values, filled rows) of the columns.
    """
    intent = intent_of(question)
    column = named_column(question, df.columns) or choose_column(question, df) or ""
    if intent == "aggregate":
        op = operation_by_words(question) or operation_by_marks(question) or "mean"
        if not column and roles:
            # a numeric column whose name shares something with the question
            column = next((c for c, n in suggest_columns(question, df, roles, ids=ids) if roles.get(c) == "numeric" and n > 20), "")
        return Plan("aggregate", source, column, op) if column else Plan("text_qa", source)
    if intent == "count_distinct":
        if counts_entities(question) and not named_column(question, df.columns) and ids:
            column = next((c for c, _ in suggest_columns(question, df, roles, ids=ids) if c in ids), ids[0])
        if column and (named_column(question, df.columns) == column or counts_distinct(question, column, ids or [], (roles or {}).get(column, ""), *(profile or {}).get(column, (0, 0)))):
            return Plan("count_distinct", source, column, "nunique")
        return Plan("count_rows", source, operation="count")
    if intent in ("count_values", "list_values"):
        return Plan(intent, source, column, "nunique", include_values=True) if column else Plan("text_qa", source)
    return Plan(intent, source, operation="count" if intent == "count_rows" else "")


# Other names of intents.
INTENT_NAMES = {"distribution": "count_values", "values": "list_values", "stat": "aggregate", "statistic": "aggregate", "count": "count_rows", "distinct": "count_distinct", "columns": "schema", "mixed": "count_values"}


def normalize_plan(plan: dict | Plan, df: DataFrame) -> Plan:
    """A proposed plan with settled names; an unknown column or operation is a ValueError."""
    p = plan if isinstance(plan, Plan) else Plan(**{k: v for k, v in plan.items() if k in Plan.__dataclass_fields__})
    p = replace(p, intent=INTENT_NAMES.get(p.intent, p.intent))
    if p.column:
        p = replace(p, column=tb.resolve_column(df, p.column))
    if p.operation:
        p = replace(p, operation=tb.operation_name(p.operation))
    return p


def compile_plan(plan: Plan, df: DataFrame) -> DataFrame:
    """The DataFrame of a plan."""
    rows = tb.filtered(df, plan.where)
    if plan.intent == "aggregate":
        return tb.table_stat(df, plan.column, plan.operation, plan.group_by or None, plan.where or None, plan.limit)
    if plan.intent == "count_rows":
        return rows.agg(F.count("*").alias("value"))
    if plan.intent == "count_distinct":
        return tb.table_stat(df, plan.column, "nunique", where=plan.where or None)
    if plan.intent in ("list_values", "count_values"):
        return tb.distinct_values(df, plan.column, plan.where or None, plan.limit)
    if plan.intent == "schema":
        return tb.table_schema(df)
    raise ValueError(f"no table plan for {plan.intent!r}")


def answer_of(plan: Plan, rows: list) -> str:
    if plan.intent == "schema":
        return f"{plan.source} has {len(rows)} columns: " + ", ".join(r["column"] for r in rows)
    if plan.intent == "count_rows":
        return f"{plan.source} has {rows[0]['value']} rows."
    if plan.intent == "count_distinct":
        return f"There are {shown_number(rows[0]['value'])} distinct values of {plan.column}."
    if plan.intent == "list_values":
        return f"Values of {plan.column}: " + ", ".join(str(r["value"]) for r in rows)
    if plan.intent == "count_values":
        return f"{plan.column}: " + ", ".join(f"{r['value']} ({r['n']})" for r in rows)
    if plan.group_by:
        return f"{plan.operation} of {plan.column} by {plan.group_by}: " + ", ".join(f"{r['grp']} {shown_number(r['value'])}" for r in rows)
    return f"The {plan.operation} of {plan.column} is {shown_number(rows[0]['value'])}."


def wanted_forms(question: str) -> dict[str, bool]:
    """Whether a spread, a list of values or a count is asked for."""
    return {"spread": asks_spread(question), "values": asks_values(question), "count": any(m in question.lower() for m in (*COUNT_MARKS, "count"))}


def table_evidence(question: str, name: str, df: DataFrame, plan: Plan, top_k: int = 5) -> list[an.Evidence]:
    """Computed evidence for a question over one table, best first: a row count, values with their counts, or a statistic."""
    if plan.intent == "count_rows":
        n = compile_plan(plan, df).first()["value"]
        return [an.Evidence(name, f"Computed row_count of {name}: {n}", 80, "table_stat", "count_rows", value=n)]
    if plan.intent in ("list_values", "count_values"):
        spread = plan.intent == "count_values"
        rows = tb.distinct_values(df, plan.column, plan.where or None, max(8, min(16, top_k * 3))).collect()
        out = [an.Evidence(name, f"Distinct {plan.column}: {r['value']} (count={r['n']})", 86 if spread else 84, "table_value", "distinct_values", plan.column, r["value"], r["n"]) for r in rows]
        if spread:
            r = tb.table_stat(df, plan.column, "nunique", where=plan.where or None).first()
            out.append(an.Evidence(name, f"Computed unique_count of {plan.column} from {r['row_count']} rows: {r['value']}", 88, "table_stat", "nunique", plan.column, r["value"]))
        return sorted(out, key=lambda e: -e.score)
    if plan.intent in ("aggregate", "count_distinct"):
        op = plan.operation or "nunique"
        r = tb.table_stat(df, plan.column, op, where=plan.where or None).first()
        label = "unique_count" if op == "nunique" and counts_entities(question) else op
        return [an.Evidence(name, f"Computed {label} of {plan.column} from {r['row_count']} rows (non-null {r['non_null']}): {shown_number(r['value'])}", 80, "table_stat", op, plan.column, r["value"])]
    return []


# Words that point back to what was said before.
BACK_WORDS = {"it", "they", "them", "those", "these", "that", "this", "there", "ones", "same"}


def points_back(question: str) -> bool:
    """Whether a question leans on the one before: few words, one of which points back, or a list of values of nothing."""
    words = {stem_word(w) for w in re.findall("[a-z0-9]+", question.lower()) if len(w) >= 2} | set(re.findall("[a-z0-9]{2,}", question.lower()))
    if asks_values(question):
        return not {w for w in words if w not in BACK_WORDS and w not in SEARCH_STOPWORDS and stem_word(w) not in ("value", "name", "list", "distinct", "unique")}
    return bool(words & BACK_WORDS) and len(words) <= 10


def counts_nothing_named(question: str) -> bool:
    """A bare 'how many?' or 'how many are there?'."""
    words = set(re.findall("[a-z]+", question.lower()))
    return bool(words) and "many" in words and words <= {"how", "many", "are", "there", "of", "in", "total", "and", "so", *BACK_WORDS}


def rewrite_follow_up(question: str, state: dict[str, str], columns: list[str] = ()) -> str:
    """The question with what it leaves out, from the state (intent, source, column) of the last answer."""
    q = " ".join(question.split())
    column, source, last = state.get("column", ""), state.get("source", ""), state.get("intent", "")
    place = f" in {source}" if source else ""
    if last == "schema":
        if counts_nothing_named(q):
            return f"How many columns are there{place}?"
        if asks_values(q) and points_back(q):
            return f"What are the column names{place}?"
    if last in ("count_values", "count_distinct", "list_values") and column:
        if counts_nothing_named(q):
            return f"How many distinct values are there for {column}{place}?"
        if asks_values(q) and points_back(q):
            return f"What are the distinct values of {column}{place}?"
    leans = re.match(r"(?:and|what about|how about|also)\b", q.lower())
    if column and (points_back(q) or leans) and not named_column(q, list(columns)):
        return f"{q.rstrip('?')} about {column}{place}" if not asks_values(q) else f"What are the distinct values of {column}{place}?"
    return q


@dataclass
class Answer:
    question: str
    plan: Plan
    answer: str
    value: object = None
    evidence_type: str = "table_stat"
    citations: list = field(default_factory=list)
    confidence: float = 0.0
    computed: bool = False
    asked: str = ""
    turn: int = 0
    code: str = ""
    reason: str = ""
    path: str = ""

    def payload(self) -> dict:
        """The result under the names of the reference's result; what a language model would have done is false or empty."""
        table = self.plan.intent != "text_qa"
        return {
            "question": self.question, "answer": self.answer, "citations": self.citations, "confidence": self.confidence, "sources_consulted": sorted({str(c[0]) for c in self.citations}), "turn_index": self.turn,
            "fallback_used": bool(self.code), "fallback_reason": self.reason, "fallback_code": self.code, "rescue_used": False, "rescue_reason": "", "deterministic_used": self.computed, "deterministic_intent": self.plan.intent if self.computed else "",
            "execution_mode": "deterministic" if self.computed else "retrieval", "llm_primary_used": False, "intent": self.plan.intent, "route_intent": intent_of(self.question), "longdoc_literal_support": None, "execution_path": self.path or ("deterministic_tabular" if self.computed else "retrieval"),
            "target_resolution": self.asked if self.asked != self.question else "", "planner_used": table, "planner_executed": self.computed, "planner_intent": self.plan.intent, "planner_source": self.plan.source, "planner_column": self.plan.column, "planner_column_recovered": bool(self.plan.column) and self.plan.column.lower() not in self.question.lower(),
            "planner_error": "", "parallel_used": False, "parallel_failures": [],
        }


class QuerySession:
    """Named tables and documents with what was asked before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.texts: DataFrame | None = None
        self.turns: list[tuple[str, str]] = []
        self.state: dict[str, str] = {}
        self._profiles: dict[str, tuple] = {}
        self.closed = False

    def add_table(self, name: str, df: DataFrame) -> str:
        from carrel.sources.readers import unique_name

        name = unique_name(name, set(self.tables))
        self.tables[name] = df
        return name

    def add_texts(self, df: DataFrame) -> None:
        """Documents as rows (source, text)."""
        self.texts = df if self.texts is None else self.texts.unionByName(df)

    def add_text_source(self, name: str, text: str) -> None:
        self.add_texts(self.spark.createDataFrame([(name, text)], "source string, text string"))

    def catalog(self) -> DataFrame:
        """(name, rows, columns) of the tables."""
        rows = [(n, df.count(), ", ".join(df.columns)) for n, df in self.tables.items()]
        return self.spark.createDataFrame(rows, "name string, rows long, columns string")

    def profile(self, name: str) -> tuple[dict[str, str], list[str], dict[str, tuple[int, int]]]:
        """(roles, identifying columns, (values, filled rows) of each column) of a table, worked out once."""
        if name not in self._profiles:
            df = self.tables[name]
            counts = {r["column"]: (r["uniques"], r["non_null"]) for r in tb.table_schema(df).collect()}
            self._profiles[name] = (tb.column_roles(df), [r["column"] for r in tb.id_candidates(df).collect()], counts)
        return self._profiles[name]

    def follow_up(self, question: str) -> str:
        """A question that leans on the one before with the column it means."""
        return rewrite_follow_up(question, self.state, [c for df in self.tables.values() for c in df.columns])

    def plan(self, question: str) -> Plan | None:
        """The plan of the table that fits a question best; None where none does."""
        best: tuple[int, Plan] | None = None
        for name, df in self.tables.items():
            if intent_of(question) == "text_qa":
                break
            roles, ids, counts = self.profile(name)
            plan = plan_question(question, name, df, roles, ids, counts)
            fit = (0 if plan.intent == "text_qa" else 10) + (5 if plan.column else 0) + (3 if name.lower() in question.lower() else 0)
            if plan.intent != "text_qa" and (best is None or fit > best[0]):
                best = (fit, plan)
        return best[1] if best else None

    def ask(self, question: str) -> Answer:
        """The answer from tables where one fits, else the best snippets of the documents.

        A schema is always read from the table, counts and lists always come from computed evidence, and a numeric question
        without a computed value is refused rather than guessed.
        """
        if self.closed:
            raise ValueError("the session is closed")
        asked = self.follow_up(question)
        plan = self.plan(asked)
        if plan:
            df = self.tables[plan.source]
            if plan.intent == "schema":
                rows = compile_plan(plan, df).collect()
                out = Answer(question, plan, answer_of(plan, rows), len(rows), "table_schema", [(plan.source, ", ".join(df.columns), 80)], 0.82, True)
            else:
                found = table_evidence(asked, plan.source, df, plan)
                stat = next((e for e in found if e.evidence_type == "table_stat"), None)
                text = an.answer_from_evidence(found, wanted_forms(asked) | {"spread": plan.intent == "count_values" and not asks_values(asked), "values": plan.include_values}) or "No evidence was found."
                out = Answer(question, plan, text, stat.value if stat else None, found[0].evidence_type if found else "", [(e.source, e.snippet, e.score) for e in found], 0.0, bool(found))
                out.confidence = an.answer_confidence(asked, text, [{"source": e.source, "snippet": e.snippet, "score": e.score, "evidence_type": e.evidence_type, "value": e.value} for e in found])
            self.state.update(intent=plan.intent, source=plan.source, column=plan.column, operation=plan.operation)
        elif self.texts is not None:
            from carrel.operators.search import search_documents

            hits = search_documents(self.texts, "source", "text", asked).collect()  # the five best
            text = hits[0]["snippet"] if hits else "No evidence was found."
            out = Answer(question, Plan("text_qa"), text, None, "text", [(h["source"], h["snippet"], h["score"]) for h in hits], 0.0, False)
            out.confidence = an.answer_confidence(asked, text, [h.asDict() for h in hits])
        else:
            out = Answer(question, Plan("text_qa"), "No evidence was found.")
        numeric = bool(operation_by_marks(asked)) and not re.search(r"\d", out.answer)
        out.answer, out.code = an.fail_closed(numeric, out.computed, out.answer)
        if out.code:
            out.confidence, out.reason = 0.0, "no computed evidence for a numeric question"
        if is_non_answer(out.answer) and not out.code:
            out.confidence = min(out.confidence, 0.2)
        out.asked, out.turn = asked, len(self.turns)
        self.turns.append((question, out.answer))
        return out

    def ask_sql(self, question: str, statement: str, name: str) -> tuple[str, list[an.Evidence]]:
        """The answer that a statement over one table (called _table) gives to a question, with its evidence."""
        rows = [r.asDict() for r in self.planned_sql(statement, name).collect()]  # at most 100 rows
        answer, evidence = an.sql_answer(question, name, statement, rows, wanted_forms(question))
        column = evidence[1].column if len(evidence) > 1 else self.state.get("column", "")
        self.state.update(intent="sql_analytic", source=name, column=column)
        return answer, evidence

    def sql(self, statement: str, limit: int = 100) -> DataFrame:
        return guarded_sql(self.spark, statement, self.tables, limit)

    def planned_sql(self, statement: str, name: str, limit: int = 100) -> DataFrame:
        """A proposed statement over one table, which it must call `_table`."""
        if not planned_sql_is_safe(statement):
            raise ValueError("the statement is not a safe select over _table")
        return guarded_sql(self.spark, statement, {"_table": self.tables[name]}, limit)

    def close(self) -> None:
        self.closed = True
        self.tables.clear()
        self.texts = None
