"""Problem 7: documents packed into containers of fixed token capacity along a space-filling curve.

Each text is tokenised once; the vector of its tokens, hashed to three dimensions, gives a point, and the point's place on a
Hilbert curve is the sort key. Items are range-partitioned and sorted by (capacity, key, id), so that documents that share
words stand together and equal keys are still spread; runs of neighbours along the curve are packed best-fit, largest first.
Containers that stay open at the end of a run take items of the next one.

Defined results: a text over the capacity is cut into pieces of exactly the capacity and a rest; texts of no tokens (empty)
go into a container at no cost; null texts are left out; documents with the same id and text count once; an id with several
texts keeps each of them, told apart by text_no.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIMS, BITS = 3, 10

_ENCODERS: dict[str, tuple] = {}


def encoder(path: str):
    """(tiktoken encoding, projection of its token ids), loaded once in each worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # hashed directions: each token id has a fixed random one
        directions = np.random.default_rng(20_24).standard_normal((max(ranks.values()) + 1, DIMS)).astype(np.float32)
        _ENCODERS[path] = (enc, directions)
    return _ENCODERS[path]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n x d) with `bits` bits a dimension, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sized_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text_hash, tokens, curve) of each distinct (id, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, directions = encoder(tokenizer)
        for pdf in parts:
            n = len(pdf)
            sizes, at = np.zeros(n, np.int64), np.zeros((n, DIMS), np.float64)
            for k, text in enumerate(pdf["text"]):
                ids = enc.encode_to_numpy(text, disallowed_special=())
                sizes[k] = ids.size
                if ids.size:
                    at[k] = directions[ids].sum(0)
            norm = np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
            grid = np.clip(((at / norm + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "tokens": sizes, "curve": hilbert_keys(grid)})

    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sized = one.mapInPandas(run, "doc_id bigint, text_hash bigint, tokens bigint, curve bigint")
    return sized.dropDuplicates(["doc_id", "text_hash"])


class Packer:
    """Best fit over the open containers of one capacity; `most_open` of them stay open between runs."""

    def __init__(self, capacity: int, most_open: int = 256) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.room: list[tuple[int, int]] = []  # (free tokens, container), sorted
        self.names: list[str] = []

    def put(self, size: int, name: str) -> int:
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            free, c = self.room.pop(k)
        else:
            free, c = self.capacity, len(self.names)
            self.names.append(name)
        if free - size > 0:
            insort(self.room, (free - size, c))
        return c

    def end_run(self) -> None:
        if len(self.room) > self.most_open:
            del self.room[: len(self.room) - self.most_open]  # the fullest are closed


def pack(sized: DataFrame, capacities: list[tuple[int, int]], run: int = 4096) -> DataFrame:
    """(capacity_id, container_id, doc_id, text_hash, piece, token_start, token_end); capacities are (id, tokens)."""
    caps = F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities])
    items = sized.select("*", F.explode(caps).alias("c")).select("doc_id", "text_hash", "tokens", "curve", "c.capacity_id", "c.capacity")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    whole = (
        items.withColumn("full", full).where("full > 0")
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
        .select("capacity_id", F.concat_ws("-", "capacity_id", "doc_id", "text_hash", "piece").alias("container_id"), "doc_id", "text_hash", "piece",
                (F.col("piece") * F.col("capacity")).alias("token_start"), ((F.col("piece") + 1) * F.col("capacity")).alias("token_end"))
    )
    rest = (
        items.withColumn("piece", full).withColumn("size", F.col("tokens") - F.col("piece") * F.col("capacity"))
        .where("size > 0 OR tokens = 0")
        .select("capacity_id", "capacity", "curve", "doc_id", "text_hash", "piece", "size", (F.col("tokens") - F.col("size")).alias("token_start"), F.col("tokens").alias("token_end"))
    )
    placed = rest.repartitionByRange("capacity_id", "curve", "doc_id", "text_hash").sortWithinPartitions("capacity_id", "curve", "doc_id", "text_hash")
    columns = ["capacity_id", "container_id", "doc_id", "text_hash", "piece", "token_start", "token_end"]

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers: dict[int, Packer] = {}
        for pdf in parts:
            for capacity_id, group in pdf.groupby("capacity_id", sort=True):
                packer = packers.setdefault(capacity_id, Packer(int(group["capacity"].iloc[0])))
                for low in range(0, len(group), run):
                    part = group.iloc[low : low + run]
                    sizes, ids, hashes, pieces = (part[c].to_numpy() for c in ("size", "doc_id", "text_hash", "piece"))
                    where = np.zeros(len(part), np.int64)
                    for k in np.argsort(-sizes, kind="stable"):
                        where[k] = packer.put(int(sizes[k]), f"{capacity_id}-{ids[k]}-{hashes[k]}-{pieces[k]}")
                    packer.end_run()
                    out = part.assign(container_id=[packer.names[c] for c in where])
                    yield out[columns]

    schema = "capacity_id int, container_id string, doc_id bigint, text_hash bigint, piece bigint, token_start bigint, token_end bigint"
    return placed.mapInPandas(fill, schema).unionByName(whole)


def capacities_of(capacity_table: DataFrame, most: int = 1000) -> list[tuple[int, int]]:
    """(capacity_id, tokens) of the valid rows; more than `most` are refused."""
    rows = capacity_table.where("capacity_id IS NOT NULL AND capacity_tokens > 0").select("capacity_id", "capacity_tokens").distinct().sort("capacity_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities")
    return [(int(r[0]), int(r[1])) for r in rows]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents with its containers, for each capacity."""
    sized = cut(sized_documents(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return pack(sized, capacities_of(table(spark, sf_dir, "pack_capacity"))).drop("text_hash")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity: containers, tokens held, the share of space used and the fewest containers thinkable."""
    caps = table(spark, sf_dir, "pack_capacity")
    placed = p7_containers(spark, sf_dir)
    per = placed.groupBy("capacity_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"))
    total = per.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    return total.join(caps.distinct(), "capacity_id").select(
        "capacity_id", "capacity_tokens", "containers", "tokens", "fullest",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"),
    )
