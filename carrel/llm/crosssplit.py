"""Problem 1: the same or nearly the same notes on both sides of a split.

Content-defined chunks: a rolling hash over two neighbouring words cuts each normalised note; the chunk digests of the two
splits are joined and the lengths of shared chunks summed into overlap fractions. A chunk that a note holds several times
counts as often, its k-th occurrence joining the k-th of another note. Only the rarest chunks of a note enter the join: those
left out make up at most `uncovered` of its words, and a chunk that at most `rare` notes hold is never left out. So two notes
that share more than that fraction in chunks, or any rare chunk, share a joined one whatever the frequencies are. Boilerplate
chunks, however often they occur, thus cost little and no cap is needed. Pairs that share a joined chunk are measured exactly,
however little it covers: words in common, each as often as it occurs, against the longer. Only pairs whose bitmaps prove a
smaller overlap are left out before that: a bit that one note has and the other lacks stands for at least one word occurrence
that the other lacks. Notes with the same words in any order are joined by a digest of their sorted words.

Notes with the same words in the same order are one class; chunks, join and measure see one representative. class_pairs and
memberships are the result of the join; pairs of records are written out only by same_notes.

Defined results: a null or wordless note belongs to no pair; repeated rows of a record count once; an id whose rows
disagree keeps each text, and a pair counts if any of them match; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.llm.textnorm import words
from carrel.session import cut, table

MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Hashes(dict):
    """64-bit hashes of words, kept while a task runs, at most about MOST_KEPT of them."""

    MOST_KEPT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
#: A chunk id is a digest with the number of words, at most 31, in its low bits.
LENGTH_BITS = 5


def content_chunks(tokens: list[str], divisor: int = 4, least: int = 2, most: int = 24) -> list[tuple[int, int]]:
    """(digest, words) of each chunk; a cut follows where the hash of two neighbouring words is 0 modulo divisor."""
    out: list[tuple[int, int]] = []
    start, before = 0, 0
    for i, h in enumerate(map(_HASHES.__getitem__, tokens), 1):
        rolled = ((before * 0x9E3779B97F4A7C15 + h) * 0xC2B2AE3D27D4EB4F) & MASK
        before = h
        n = i - start
        if n >= least and (rolled >> 40) % divisor == 0 or n >= most:
            out.append((_signed(xxhash.xxh3_64_intdigest(" ".join(tokens[start:i]))), n))
            start = i
    if start < len(tokens):
        out.append((_signed(xxhash.xxh3_64_intdigest(" ".join(tokens[start:]))), len(tokens) - start))
    return out


def chunk_ids(tokens: list[str], divisor: int = 4) -> list[int]:
    """One id for each chunk and its how-manieth occurrence, the chunk's words in the low bits; last the id, of length 0, of the sorted words."""
    seen: dict[int, int] = {}
    out = []
    for digest, n in content_chunks(tokens, divisor):
        k = seen[digest] = seen.get(digest, 0) + 1
        if k > 1:
            digest = xxhash.xxh3_64_intdigest(digest.to_bytes(8, "big", signed=True), seed=k)
        out.append(_signed((digest << LENGTH_BITS | n) & MASK))
    out.append(_signed(xxhash.xxh3_64_intdigest("\n".join(sorted(tokens))) << LENGTH_BITS & MASK))
    return out


def word_bag(tokens: list[str]) -> list[int]:
    """One number for each word and its how-manieth occurrence: the size of a set intersection is that of the bags."""
    seen: dict[str, int] = {}
    out = []
    for w in tokens:
        k = seen[w] = seen.get(w, 0) + 1
        out.append(_HASHES[w] if k == 1 else xxhash.xxh3_64_intdigest(w, seed=k))
    return out


def shared_words(a: str, b: str) -> tuple[int, int]:
    """(words in common, each as often as it occurs; words of the longer)."""
    x, y = words(a), words(b)
    return (Counter(x) & Counter(y)).total(), max(len(x), len(y))


BITMAP_WORDS = 16


def bitmap(bag: list[int]) -> np.ndarray:
    """One bit for each member of a bag, modulo 64 * BITMAP_WORDS, as signed 64-bit numbers."""
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[np.array(bag, np.uint64) % (64 * BITMAP_WORDS)] = 1
    return np.packbits(bits).view(np.int64)


def lacking(a: str, b: str) -> Column:
    """At least so many members of the bag of bitmap columns a0, a1, ... are not in that of b0, b1, ..."""
    return reduce(add, [F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.bitwise_not(f"{b}{i}"))) for i in range(BITMAP_WORDS)])


PROFILE = "side int, rid bigint, text_id binary, class_id binary, n int, bits array<bigint>, chunks array<bigint>"


def split_notes(train: DataFrame, test: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(side, rid, text), 0 for train and 1 for test, without nulls and repeats."""
    one = lambda df, side: df.select(F.lit(side).alias("side"), F.col(id_col).cast("bigint").alias("rid"), F.col(text_col).alias("text"))
    return one(train, 0).unionByName(one(test, 1)).where(F.col("rid").isNotNull() & F.col("text").isNotNull()).distinct()


def note_profiles(notes: DataFrame, divisor: int = 4) -> DataFrame:
    """(side, rid, text) to PROFILE rows; class_id is a 128-bit digest of the words in order, text_id one of the text itself."""

    def profile(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for side, rid, text in zip(pdf["side"], pdf["rid"], pdf["text"]):
                tokens = words(text)
                if tokens:
                    name = xxhash.xxh3_128_digest(" ".join(tokens))
                    out.append((side, rid, hashlib.md5(text.encode(), usedforsecurity=False).digest(), name, len(tokens), bitmap(word_bag(tokens)), chunk_ids(tokens, divisor)))
            yield pd.DataFrame(out, columns=["side", "rid", "text_id", "class_id", "n", "bits", "chunks"])

    return notes.mapInPandas(profile, PROFILE)


def _length(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))


def _kept_chunks(classes: DataFrame, uncovered: float, rare: int, hot: int) -> DataFrame:
    """(class_id, in_train, in_test, chunk, salts): the chunks of each class that enter the join."""
    rows = classes.select("class_id", "n", "in_train", "in_test", F.explode("chunks").alias("chunk"))
    counts = rows.groupBy("chunk").agg(F.count("*").alias("df"), F.max("in_train").alias("a"), F.max("in_test").alias("b"))
    # a chunk seen in one class or on one side only joins nothing; its words count as the rarest
    useful = counts.where("a AND b AND df > 1").select("chunk", "df")
    ranked = rows.join(useful, "chunk").groupBy("class_id").agg(
        F.first("n").alias("n"), F.first("in_train").alias("in_train"), F.first("in_test").alias("in_test"), F.array_sort(F.collect_list(F.struct("df", "chunk"))).alias("cs"),
    )
    shared = F.aggregate("cs", F.lit(0).cast("bigint"), lambda acc, c: acc + _length(c["chunk"]))
    kept = F.aggregate(
        "cs",
        F.struct((F.col("n") - shared).alias("words"), F.expr("cast(array() as array<struct<df: bigint, chunk: bigint>>)").alias("kept")),
        lambda acc, c: F.when((acc["words"] > F.col("n") * (1 - uncovered)) & (c["df"] > rare) & (_length(c["chunk"]) > 0), acc).otherwise(
            F.struct((acc["words"] + _length(c["chunk"])).alias("words"), F.concat(acc["kept"], F.array(c)).alias("kept"))
        ),
        lambda acc: acc["kept"],
    )
    return ranked.select("class_id", "in_train", "in_test", F.explode(kept).alias("c")).select("class_id", "in_train", "in_test", "c.chunk", F.ceil(F.col("c.df") / hot).cast("int").alias("salts"))


def note_classes(profiles: DataFrame) -> DataFrame:
    """(class_id, n, bits, chunks, in_train, in_test, side, rid, text_id): a row for each class, the last three naming a member."""
    return profiles.groupBy("class_id").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("chunks").alias("chunks"), F.max(F.col("side") == 0).alias("in_train"), F.max(F.col("side") == 1).alias("in_test"),
        F.min(F.struct("side", "rid", "text_id")).alias("m"),
    ).select("class_id", "n", "bits", "chunks", "in_train", "in_test", "m.*")


def class_pairs(notes: DataFrame, profiles: DataFrame, least_overlap: float = 0.8, uncovered: float = 0.15, rare: int = 32, hot: int = 10_000) -> DataFrame:
    """(ca, cb, overlap, chunk_overlap) of the classes of train and test notes whose overlap is least_overlap or more.

    uncovered: share of a note's words whose (most frequent) chunks may stay out of the join; rare: chunks of at most so many
    classes never do. hot: a chunk of more classes is split among that many times fewer keys. chunk_overlap: summed lengths of all
    chunks both notes hold, each as often as it occurs, over the longer note's words.
    """
    classes = cut(note_classes(profiles))
    kept = cut(_kept_chunks(classes, uncovered, rare, hot))
    marks = classes.select("class_id", "n", *[F.col("bits")[i].alias(f"m{i}") for i in range(BITMAP_WORDS)])
    side = lambda x: [F.col("class_id").alias(f"c{x}"), F.col("n").alias(f"n{x}"), *[F.col(f"m{i}").alias(f"{x}{i}") for i in range(BITMAP_WORDS)]]
    a = kept.where("in_train").join(marks, "class_id").select("chunk", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), *side("a"))
    b = kept.where("in_test").join(marks, "class_id").select("chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *side("b"))
    longer = F.greatest("na", "nb")
    shared = F.least(F.col("na") - lacking("a", "b"), F.col("nb") - lacking("b", "a"))
    near = a.join(b, ["chunk", "salt"]).where((F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= least_overlap * longer) & (shared >= least_overlap * longer)).select("ca", "cb").distinct()
    near = cut(near)
    # only the notes of such pairs are read again
    wanted = near.select(F.col("ca").alias("class_id")).unionByName(near.select(F.col("cb").alias("class_id"))).distinct()
    members = classes.join(wanted, "class_id", "left_semi").select("class_id", "side", "rid", "text_id", "chunks")
    texts = members.join(notes.withColumn("text_id", F.unhex(F.md5("text"))), ["side", "rid", "text_id"]).select("class_id", "text", "chunks")
    of = lambda c, x: texts.select(F.col("class_id").alias(c), F.col("text").alias(f"text_{x}"), F.col("chunks").alias(f"chunks_{x}"))
    measured = near.join(of("ca", "a"), "ca").join(of("cb", "b"), "cb").withColumn("w", _shared("text_a", "text_b"))
    common = F.aggregate(F.array_intersect("chunks_a", "chunks_b"), F.lit(0).cast("bigint"), lambda acc, c: acc + _length(c))
    measured = measured.select("ca", "cb", (F.col("w.common") / F.col("w.longer")).alias("overlap"), (common / F.col("w.longer")).alias("chunk_overlap")).where(F.col("overlap") >= least_overlap)
    own = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda acc, c: acc + _length(c)) / F.col("n")
    equal = classes.where(F.col("in_train") & F.col("in_test")).select(F.col("class_id").alias("ca"), F.col("class_id").alias("cb"), F.lit(1.0).alias("overlap"), own.alias("chunk_overlap"))
    return measured.unionByName(equal)


@F.pandas_udf(T.StructType([T.StructField("common", T.IntegerType()), T.StructField("longer", T.IntegerType())]))
def _shared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shared_words(x, y) for x, y in zip(a, b)], columns=["common", "longer"])


def same_notes(train: DataFrame, test: DataFrame, id_col: str, text_col: str, least_overlap: float = 0.8, divisor: int = 4, uncovered: float = 0.15) -> DataFrame:
    """(train_id, test_id, overlap, chunk_overlap) of all pairs of records whose overlap is least_overlap or more."""
    notes = split_notes(train, test, id_col, text_col)
    profiles = cut(note_profiles(notes, divisor))
    pairs = class_pairs(notes, profiles, least_overlap, uncovered)
    members = profiles.select("side", "rid", "class_id").distinct()
    left = members.where("side = 0").select(F.col("class_id").alias("ca"), F.col("rid").alias("train_id"))
    right = members.where("side = 1").select(F.col("class_id").alias("cb"), F.col("rid").alias("test_id"))
    return pairs.join(left, "ca").join(right, "cb").groupBy("train_id", "test_id").agg(F.max("overlap").alias("overlap"), F.max("chunk_overlap").alias("chunk_overlap"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = same_notes(table(spark, sf_dir, "extract_train"), table(spark, sf_dir, "extract_test"), "record_id", "document_text")
    return pairs.select("train_id", "test_id")


def p1_overlap_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping test notes by eval_split and source: their number, the pairs of notes and the mean overlap.

    Pairs are counted by the sizes of the classes, not written out. A note is a different text of a record.
    """
    train, test = table(spark, sf_dir, "extract_train"), table(spark, sf_dir, "extract_test")
    notes = split_notes(train, test, "record_id", "document_text")
    profiles = cut(note_profiles(notes))
    sizes = profiles.where("side = 0").groupBy(F.col("class_id").alias("ca")).agg(F.count("*").alias("members"))
    by_class = class_pairs(notes, profiles).join(sizes, "ca").groupBy(F.col("cb").alias("class_id")).agg(F.sum("members").alias("pairs"), F.sum(F.col("members") * F.col("overlap")).alias("total"))
    hits = profiles.where("side = 1").select("rid", "class_id").join(by_class, "class_id").groupBy(F.col("rid").alias("test_id")).agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))
    of = test.where("record_id IS NOT NULL").select(F.col("record_id").cast("bigint").alias("test_id"), "eval_split", "source_name").groupBy("test_id").agg(F.min(F.struct("eval_split", "source_name")).alias("s"))
    return (
        of.join(hits, "test_id", "left")
        .groupBy(F.col("s.eval_split").alias("eval_split"), F.col("s.source_name").alias("source_name"))
        .agg(F.count("*").alias("test_notes"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.sum("total") / F.sum("pairs"), 6).alias("mean_overlap"))
    )
