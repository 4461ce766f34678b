"""Problem 6: texts over a size limit cut into numbered pieces at natural boundaries, with overlap.

One bounded-quantifier pattern extracts the cores of the pieces: its alternatives, ordered by the strength of the boundary
they end at, consume up to the limit less the overlap; a core that only its full size can bring to a natural boundary may
take the whole limit; white space and then any character are the fallback. Each piece then looks back from its core by the
overlap, or less where a natural boundary lies in between. Everything is a column expression; pieces are an array column.

A natural boundary is a run of white space that contains a line feed or follows '.', '!' or '?'.

Defined results: null text gives no piece, an empty or short text one piece (empty text: none); the cores put together are
the text; repeated rows count once; an id with several texts keeps the pieces of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import table

LIMIT, OVERLAP = 1800, 220
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
#: The white space of a natural boundary, as far as a core takes it in.
_BREAK = rf"(?:(?<=[.!?]){WS}|\n){WS}{{0,18}}"
_PARAGRAPH = rf"\n[^\S\n]{{0,4}}\n{WS}{{0,14}}"
def core_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    body = limit - overlap
    room = body - 20
    return (
        rf"(?sU){WS}*+(?:.{{1,{body}}}\z"
        rf"|.{{{room // 2},{room}}}{_PARAGRAPH}"
        rf"|.{{{room // 4},{room}}}{_BREAK}"
        rf"|.{{1,{room}}}{_BREAK}"
        rf"|.{{1,{limit}}}?(?={WS}*\z|[^\S\n]{{0,40}}\n|(?<=[.!?]){WS})"
        rf"|.{{1,{body - 1}}}{WS}(?={NOT_WS})"
        rf"|.{{1,{body}}})|{WS}++"
    )


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def split_pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<chunk_id, char_start, char_end, core_start, natural>>; offsets 0-based, end exclusive."""

    def of_cores(cores: Column) -> Column:
        ends = F.aggregate(cores, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(c))))
        return let(ends, lambda e: F.transform(cores, lambda c, i: piece(c, i, e, F.size(cores))))

    def piece(core: Column, i: Column, ends: Column, n: Column) -> Column:
        start, end = ends[i], ends[i + 1]
        room = F.lit(limit) - (end - start)
        back = F.greatest(F.lit(0), F.least(F.lit(overlap), start, room))
        lead = F.char_length(core) - F.char_length(F.regexp_replace(core, rf"(?U)\A{WS}+", ""))
        # the window begins one character early: is its start itself behind a boundary?
        window = F.substring(text, start - back + 1, back)
        first = F.char_length(F.regexp_extract(window, rf"(?sU)\A.*?(?:[.!?]{WS}|\n){WS}*+(?={NOT_WS})", 0))
        aligned = F.when((first > 0) & (first < back), back - first).otherwise(back)
        # white space that a long stretch pushed into its successor counts for no piece where it would burst the limit
        begin = F.when(room < 0, start + lead).when((i == 0) | (back == 0), start).otherwise(start - aligned)
        natural = (i == n - 1) | core.rlike(rf"(?sU)(?:[.!?]{WS}|\n){WS}*\z") | F.substring(text, end + 1, 42).rlike(rf"(?sU)\A[^\S\n]*\n") | (
            core.rlike(r"(?s)[.!?]\z") & F.substring(text, end + 1, 1).rlike(rf"(?U){WS}"))
        return F.struct(i.cast("int").alias("chunk_id"), begin.cast("bigint").alias("char_start"), end.cast("bigint").alias("char_end"), start.cast("bigint").alias("core_start"), natural.alias("natural"))

    return let(F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(0)), of_cores)


def with_pieces(docs: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text, pieces), a row for each distinct (id, text)."""
    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    return one.withColumn("pieces", split_pieces(F.col("text"), limit, overlap))


def unbroken_stretches(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, char_start, char_end) of stretches over the limit without a natural boundary inside.

    They come from the cores alone: one that ends at no boundary holds none, so a stretch goes from the first letter of the
    first of such cores in a row to the first boundary of the core behind them, which its lazy alternative finds.
    """
    forced = pieces.where(F.exists("pieces", lambda p: ~p["natural"]))
    cores = F.transform("pieces", lambda p: F.struct(p["core_start"].alias("s"), p["char_end"].alias("e"), p["natural"].alias("natural")))
    first = F.filter(F.transform(cores, lambda c, i: F.when(~c["natural"] & ((i == 0) | F.get(cores, i - 1)["natural"]), i)), lambda i: i.isNotNull())
    runs = forced.select("doc_id", "text", cores.alias("cores"), F.explode(first).alias("i"))
    # the first core behind the run; the text's last core counts as ending at a boundary
    after = F.get(F.filter(F.sequence(F.col("i") + 1, F.size("cores") - 1), lambda j: F.get(F.col("cores"), j)["natural"]), F.lit(0))
    runs = runs.select("doc_id", "text", F.get(F.col("cores"), F.col("i"))["s"].alias("s"), F.get(F.col("cores"), after).alias("last"))
    core = F.expr("substring(text, int(last.s) + 1, int(last.e - last.s))")
    # white space before a stretch is no part of it unless the text begins with it
    lead = F.char_length(F.regexp_extract(F.expr("substring(text, int(s) + 1, int(last.e - s))"), rf"(?U)\A{WS}*+", 0))
    start = F.when((F.col("s") == 0) & ~F.expr("substring(text, 1, 1)").rlike(r"\n") & (lead > 0) & ~F.regexp_extract(F.col("text"), rf"(?U)\A{WS}*+", 0).contains("\n"), F.lit(0)).otherwise(F.col("s") + lead)
    end = F.col("last.s") + F.char_length(F.regexp_extract(core, stretch_end(limit), 0))
    out = runs.select("doc_id", start.cast("bigint").alias("char_start"), end.cast("bigint").alias("char_end"))
    return out.where(F.col("char_end") - F.col("char_start") > limit).distinct()


def stretch_end(limit: int = LIMIT) -> str:
    """The rest of a stretch at the beginning of a core: up to the white space of the first natural boundary."""
    return rf"(?sU)\A.{{0,{limit}}}?(?=[^\S\n]*\n|(?<=[.!?]){WS}|\z)"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_pieces(table(spark, sf_dir, "loaded_document"), "loaded_id", "text")
    return unbroken_stretches(docs).withColumnRenamed("doc_id", "loaded_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text over the limit, with their texts."""
    docs = with_pieces(table(spark, sf_dir, "loaded_document"), "loaded_id", "text").where(F.char_length("text") > LIMIT)
    rows = docs.select(F.col("doc_id").alias("loaded_id"), "text", F.explode("pieces").alias("p"))
    return rows.select("loaded_id", "p.chunk_id", "p.char_start", "p.char_end", "p.natural", F.expr("substring(text, int(p.char_start) + 1, int(p.char_end - p.char_start))").alias("piece"))


def evidence_chunks(evidence: DataFrame, pieces: DataFrame, salts: int = 8) -> DataFrame:
    """(evidence_id, loaded_id, chunk_id, whole): the first piece that holds the span, else the first that holds most of it.

    A null or reversed span, or an unknown document, has a null chunk_id. A document that very many rows point at is
    spread over `salts` copies of its pieces.
    """
    small = pieces.groupBy("doc_id").agg(F.max_by("pieces", F.struct(F.char_length("text"), "text")).alias("pieces"))
    small = small.select(F.col("doc_id").alias("loaded_id"), F.transform("pieces", lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["char_start"].alias("s"), p["char_end"].alias("e"))).alias("pieces"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = evidence.select("evidence_id", "loaded_id", "char_start", "char_end").distinct().withColumn("salt", F.pmod(F.xxhash64("evidence_id"), F.lit(salts)).cast("int"))
    held = lambda p: F.least(p["e"], F.col("char_end")) - F.greatest(p["s"], F.col("char_start"))
    valid = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    best = F.array_max(F.transform(F.filter("pieces", lambda p: valid & (held(p) > 0)), lambda p: F.struct(held(p).alias("held"), (-p["chunk_id"]).alias("neg"))))
    out = rows.join(small, ["loaded_id", "salt"], "left").withColumn("best", best)
    return out.select(
        F.col("evidence_id").cast("bigint").alias("evidence_id"), F.col("loaded_id").cast("bigint").alias("loaded_id"), (-F.col("best.neg")).alias("chunk_id"),
        (F.col("best.held") == F.col("char_end") - F.col("char_start")).alias("whole"),
    )


def p6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = with_pieces(table(spark, sf_dir, "loaded_document"), "loaded_id", "text")
    return evidence_chunks(table(spark, sf_dir, "outlines_evidence"), pieces)
