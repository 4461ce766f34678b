"""Read-only SQL over registered tables: the parsed plan is inspected, not the string."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Rows that a pass-through query returns at most.
MOST_ROWS = 500
# Nodes of parsed plans that only read. A node that is not among them (a command, an insert, a file or table
# function) refuses the statement wherever it stands.
READING = {
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Filter", "UnresolvedWith", "WithCTE", "Union", "Except", "Intersect", "UnresolvedHaving", "SubqueryAlias", "Offset", "WithWindowDefinition", "Deduplicate",
    "Join", "LateralJoin", "Generate", "UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "Pivot", "Unpivot", "UnresolvedSubqueryColumnAliases", "Expand", "Window", "Tail", "Sample", "UnresolvedHint", "LogicalPlanIntegrity",
}
# Words that a planned statement must not hold.
DENIED = ("insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "copy", "export", "import", "install", "load", "pragma", "call")

# Expressions that hold a plan of their own, and functions that leave the tables.
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


def check_select(spark: SparkSession, sql: str, tables=None) -> None:
    """A ValueError unless the text is one statement that only reads, and only the named tables where they are given."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise ValueError("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"not a single readable statement: {str(e).splitlines()[0]}") from e
    _check_node(plan, set(), None if tables is None else {t.lower() for t in tables})


def _each(seq):
    """The elements of a Scala sequence."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _check_node(plan, named: set[str], tables: set[str] | None) -> None:
    """Refuse any node, CTE or subquery that does more than read the given tables. named: common table expressions in scope."""
    node = plan.nodeName()
    if node == "UnresolvedWith":
        scope = set(named)
        for pair in _each(plan.cteRelations()):
            # a definition sees the ones before it, a recursive one itself too
            name = pair._1().lower()
            _check_node(pair._2(), scope | {name}, tables)
            scope.add(name)
        _check_node(plan.child(), scope, tables)
        return
    if node not in READING:
        raise ValueError(f"only queries are allowed, not {node}")
    if node == "UnresolvedRelation":
        parts = list(_each(plan.multipartIdentifier()))
        if len(parts) != 1 or tables is not None and parts[0].lower() not in tables | named:
            raise ValueError(f"unknown table {'.'.join(parts)}")
    for e in _each(plan.expressions()):
        _check_expression(e, named, tables)
    for c in _each(plan.children()):
        _check_node(c, named, tables)


def _check_expression(e, named: set[str], tables: set[str] | None) -> None:
    if e.nodeName() in SUBQUERIES:
        _check_node(e.plan(), named, tables)
    if e.nodeName() == "UnresolvedFunction" and (name := ".".join(_each(e.nameParts())).lower()) in DENIED_FUNCTIONS:
        raise ValueError(f"function {name} is not allowed")
    for c in _each(e.children()):
        _check_expression(c, named, tables)


def guarded_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """The rows, at most 500, of a reading statement over the given tables alone.

    Any other relation (a table of the catalog, a file such as text.`/etc/hostname`) and any node that writes, at any depth, is a
    ValueError. The tables are seen under their names while the statement is resolved; no view stays behind.
    """
    check_select(spark, sql, tables)
    known = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql.strip().rstrip(";")).limit(max(1, min(MOST_ROWS, limit)))
    finally:
        for name in tables:
            if name not in known:
                spark.catalog.dropTempView(name)


def planned_sql_is_safe(sql: str, relation: str = "_table") -> bool:
    """The check of a planned statement: a select over the one relation without denied words."""
    text = sql.strip().lower()
    return text.startswith("select") and ";" not in text and relation in text and not re.search(r"\b(?:" + "|".join(DENIED) + r")\b", text)
