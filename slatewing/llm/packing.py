"""Filling containers of fixed capacity with documents (problem 6), by exact-complement hashing.

Only the histogram of lengths is planned: at most ``capacity`` counters. Sums of single lengths, pairs
and triples are indexed; from the longest down, each length takes the combination that fills its gap
exactly, as often as the counts allow; where none does, the best fitting length is added and the rest
of the gap tried again. The plan's recipes are then dealt to the documents by their rank within their
length, so no document visits the driver and no task holds all documents of one length.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Documents of one length are ranked in buckets of about so many.
BUCKET_ROWS = 50_000
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this vocabulary family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)``; null and empty texts have none, rows without doc_id are left out."""
    path = f"{tokenizers}/{vocabulary}"

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for frame in frames:
            tokens = [len(encode(t)) if t else 0 for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "tokens": tokens})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(count, "doc_id long, tokens int")


class _Stock:
    """How many items of each length are left, with an index of the sums of pairs."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.stale = True

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length, uses in Counter(lengths).items():
            self.left[length] -= uses * times
            self.stale = self.stale or self.left[length] < 2

    def times(self, lengths: tuple[int, ...]) -> int:
        return int(min(self.left[length] // uses for length, uses in Counter(lengths).items()))

    def largest(self, limit: int, held: tuple[int, ...]) -> int:
        own = Counter(held)
        for length in np.flatnonzero(self.left[: limit + 1])[::-1]:
            if length and self.left[length] > own[int(length)]:
                return int(length)
        return 0

    def single(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > held.count(gap) else None

    def pair(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        a = np.arange((gap + 1) // 2, gap)
        if not len(a):
            return None
        own = Counter(held)
        for big in a[(self.left[a] > 0) & (self.left[gap - a] > 0)][::-1]:
            need = own + Counter((int(big), int(gap - big)))
            if all(self.left[k] >= n for k, n in need.items()):
                return int(big), int(gap - big)
        return None

    def triple(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        if self.stale:
            there = (self.left > 0).astype(np.float64)
            there[0] = 0
            size = 1 << (2 * len(there)).bit_length()
            sums = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)
            self.pairs, self.stale = sums[: len(there)] > 0.5, False
        a = np.flatnonzero((self.left[1:gap] > 0) & self.pairs[gap - 1 : 0 : -1]) + 1
        for first in a[::-1]:
            if rest := self.pair(int(gap - first), (*held, int(first))):
                return int(first), *rest
        return None

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        return self.single(gap, held) or self.pair(gap, held) or self.triple(gap, held)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Recipes ``(lengths, containers)`` that use up ``counts`` (by length, up to ``capacity``)."""
    stock = _Stock(counts[: capacity + 1])
    recipes: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while stock.left[length] > 0:
            held: tuple[int, ...] = (length,)
            gap = capacity - length
            while gap > 0:
                if found := stock.exact(gap, held):
                    held, gap = held + found, 0
                elif best := stock.largest(gap, held):
                    held, gap = (*held, best), gap - best
                else:
                    break
            times = stock.times(held)
            recipes.append((held, times))
            stock.take(held, times)
    return recipes


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece_no, tokens, container, position)``: each item's container and place in it.

    An item larger than the capacity is cut into full containers and a remainder; no other is cut.
    Items without size (or null) take no room and stand behind the others in container 0. Items with a
    null key are left out. Repeated rows are packed each.
    """
    whole = F.col(size).cast("long")
    n = F.coalesce(F.greatest(whole, F.lit(0)), F.lit(0))
    full = F.floor((F.greatest(n, F.lit(1)) - 1) / capacity).cast("int")
    pieces = sizes.where(F.col(key).isNotNull()).select(
        F.col(key), n.alias("n"), F.explode(F.sequence(F.lit(0), full)).alias("piece_no"), full.alias("last_piece")
    ).select(
        key,
        "piece_no",
        F.when(F.col("piece_no") < F.col("last_piece"), capacity).otherwise(F.col("n") - F.col("last_piece") * capacity).cast("int").alias("tokens"),
    )
    rows = pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows, whatever the number of items
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r.tokens] = r.n
    recipes = plan(np.concatenate(([0], counts[1:])), capacity)
    # blocks of ranks within a length: (length, first rank) -> (first container, position)
    blocks: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    container = 0
    for lengths, times in recipes:
        for position, length in enumerate(lengths):
            blocks.setdefault(length, []).append((used[length], container, position))
            used[length] += times
        container += times
    blocks[0] = [(0, 0, len(recipes[0][0]) if recipes else 0)]
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in blocks.items()}

    # a frequent length has as many buckets as its count asks for
    parts = [(int(r.tokens), 1 + int(r.n) // BUCKET_ROWS) for r in rows]
    buckets = F.broadcast(sizes.sparkSession.createDataFrame(parts, "tokens int, buckets long"))
    bucket = F.pmod(F.xxhash64(key, "piece_no"), F.col("buckets")).alias("bucket")
    pieces = pieces.join(buckets, "tokens").select(key, "piece_no", "tokens", bucket)
    counted = pieces.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("tokens", "bucket").orderBy(key, "piece_no")
    ranked = pieces.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["tokens", "bucket"]).select(
        key, "piece_no", "tokens", (F.col("r") + F.col("offset")).alias("place")
    )
    kind = dict(sizes.dtypes)[key]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = frame["place"].to_numpy()
            container, position = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, at in frame.groupby("tokens").indices.items():
                first, base, slot = table[int(length)]
                if length == 0:
                    position[at] = slot[0] + place[at]
                    continue
                block = np.searchsorted(first, place[at], side="right") - 1
                container[at] = base[block] + place[at] - first[block]
                position[at] = slot[block]
            yield frame[[key, "piece_no", "tokens"]].assign(container=container, position=position)

    return ranked.mapInPandas(deal, f"{key} {kind}, piece_no int, tokens int, container long, position long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The container and position of every document (see :func:`pack`), sizes in tokens."""
    from slatewing.session import durable

    # counted once: the histogram and the dealing both read it
    return pack(durable(token_counts(documents, tokenizers, vocabulary)), capacity=capacity)
