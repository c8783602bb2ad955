"""Filling containers of a fixed capacity by exact complements.

Only the histogram of item lengths (at most `capacity` numbers, whatever the data's size)
comes to the driver. There containers are planned as patterns, multisets of lengths with a
multiplicity: a pattern starts with the largest lengths left; as soon as an available
single, pair or triple of lengths fills its gap exactly it is consumed as often as the counts allow;
what finds no complement is placed by best fit. Items then look their place up by length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tokens import VOCABULARY, n_tokens
from larkspur.plans.durable import checkpoint, salted_rank

CAPACITY = 2048
#: Items of one length that are ranked in one task.
PER_SALT = 50_000


class SumIndex:
    """Which sums of one, two or three available lengths exist, kept up to date as counts run out."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64).copy()
        self.capacity = len(counts) - 1
        have = np.flatnonzero(self.n)
        self.pairs = np.zeros(2 * self.capacity + 1, dtype=np.int64)
        for a in have:
            self._pairs_of(a, have[have >= a], 1)

    def _pairs_of(self, a: int, others: np.ndarray, sign: int) -> None:
        np.add.at(self.pairs, a + others, sign)

    def take(self, length: int, k: int) -> None:
        """Consume k items of a length."""
        self.n[length] -= k
        if self.n[length] == 0:
            have = np.flatnonzero(self.n)
            self._pairs_of(length, np.append(have, length), -1)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] else None

    def pair(self, gap: int, top: int | None = None) -> tuple[int, ...] | None:
        """The pair with the largest longer part (at most `top`)."""
        top = min(gap - 1, self.capacity if top is None else top)
        low = (gap + 1) // 2
        if top < low or not self.pairs[gap]:
            return None
        a = np.arange(top, low - 1, -1)
        hit = (self.n[a] > 0) & (self.n[gap - a] > 0)
        if gap % 2 == 0 and self.n[gap // 2] < 2:
            hit &= a != gap // 2
        where = np.flatnonzero(hit)
        return (int(a[where[0]]), gap - int(a[where[0]])) if len(where) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """A triple of distinct or sufficiently counted lengths, its longest part as large as possible."""
        a = np.arange(min(gap - 2, self.capacity), (gap + 2) // 3 - 1, -1)
        if not len(a):
            return None
        for x in a[(self.n[a] > 0) & (self.pairs[gap - a] > 0)]:
            x = int(x)
            two = self.pair(gap - x, x)
            if two and all(self.n[v] >= (x, *two).count(v) for v in two):
                return (x, *two)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    times: int


def plan(counts: np.ndarray) -> list[Pattern]:
    """Containers for `counts[l]` items of each length l (0 < l <= capacity); every item is placed exactly once."""
    capacity = len(counts) - 1
    index = SumIndex(counts)
    patterns: list[Pattern] = []
    rest: dict[int, int] = {}

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(index.n[v]) // lengths.count(v) for v in set(lengths))

    have = [int(v) for v in np.flatnonzero(index.n)]
    while have:
        base: list[int] = []
        gap, done = capacity, None
        drawn: dict[int, int] = {}
        while gap:
            # lengths already in the base are not available to the complement a second time
            for v, k in drawn.items():
                index.n[v] -= k
            found = index.complement(gap) if gap <= 3 * have[-1] else None
            for v, k in drawn.items():
                index.n[v] += k
            if found:
                done = (*base, *found)
                break
            at = bisect.bisect_right(have, gap) - 1
            while at >= 0 and index.n[have[at]] - drawn.get(have[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            base.append(have[at])
            drawn[have[at]] = drawn.get(have[at], 0) + 1
            gap -= have[at]
        if done is None and gap == 0:
            done = tuple(base)
        if done is None:
            # nothing fills this base exactly: its largest item waits for best fit
            first = base[0]
            k = int(index.n[first])
            rest[first] = rest.get(first, 0) + k
            index.take(first, k)
        else:
            k = times(done)
            patterns.append(Pattern(done, k))
            for v in set(done):
                index.take(v, k * done.count(v))
        have = [v for v in have if index.n[v]]
    return patterns + best_fit(rest, capacity)


def best_fit(rest: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of lengths in decreasing order, whole runs of equal containers at a time."""
    open_: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], k: int) -> None:
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append(Pattern(lengths, k))

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * length, (length,) * (n % each), 1)
                break
            gap = gaps[at]
            p = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            each = min(gap // length, n)
            k = min(p.times, n // each)
            if k < p.times:
                put(gap, p.lengths, p.times - k)
            put(gap - each * length, p.lengths + (length,) * each, k)
            n -= k * each
    return [p for ps in open_.values() for p in ps]


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """(length, start, each, container): items of a length with rank >= start go, `each` to a container, to container, container + 1, ..."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for p in patterns:
        for v in sorted(set(p.lengths)):
            each = p.lengths.count(v)
            rows.append((v, used.get(v, 0), each, first))
            used[v] = used.get(v, 0) + each * p.times
        first += p.times
    return pd.DataFrame(rows, columns=["length", "start", "each", "container"]).sort_values(["length", "start"], ignore_index=True)


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, length): one row per text, or per piece of `capacity` tokens where a text alone exceeds a container.

    Null and empty texts have no tokens, need no room and give no row. Repeated rows are separate items
    (`row` tells them apart); a null doc_id is kept as it is.
    """
    # every other text has a token; a filter on the count would have it counted twice
    filled = documents.filter("text is not null and text != ''")
    sized = filled.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), n_tokens(F.col("text"), vocabulary).alias("n"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity)))
    length = F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int")
    return sized.select("doc_id", "row", "n", cut.alias("piece")).select("doc_id", "row", "piece", length.alias("length"))


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, piece, length): the container of every piece of every text."""
    items = pieces(documents, capacity, vocabulary)
    # equal rows are told apart by their number within (doc_id, text, piece)
    items = checkpoint(items.groupBy("doc_id", "row", "piece", "length").agg(F.count(F.lit(1)).alias("k")))
    items = items.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).drop("k")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    table = slots(plan(counts))
    shared = items.sparkSession.sparkContext.broadcast(
        (table["length"].to_numpy(np.int64), table["start"].to_numpy(np.int64), table["each"].to_numpy(np.int64), table["container"].to_numpy(np.int64))
    )
    # one length may be that of most items (all pieces of long texts have the capacity): as many salts as its items need
    salts = max(1, -(-int(counts.max()) // PER_SALT))
    ranked = salted_rank(items, ["length"], ["doc_id", "row", "piece", "copy"], "rank", salts).select("doc_id", "piece", "length", "rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, starts, each, first = shared.value
        shift = np.int64(1) << np.int64(48)
        keys = lengths * shift + starts
        for b in batches:
            at = np.searchsorted(keys, b["length"].to_numpy(np.int64) * shift + b["rank"].to_numpy(np.int64), side="right") - 1
            b["container_id"] = first[at] + (b["rank"].to_numpy(np.int64) - starts[at]) // each[at]
            yield b[["container_id", "doc_id", "piece", "length"]]

    return ranked.mapInPandas(place, "container_id bigint, doc_id bigint, piece bigint, length int")


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_ids, pieces, first_tokens, fill, room): a container holds at most `capacity` items, so its lists are bounded.

    pieces and first_tokens go with doc_ids: the number of the piece of the text (0 for a whole one) and the place of its first token.
    """
    placed = pack(documents, capacity, vocabulary)
    return placed.groupBy("container_id").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "piece"))).alias("_items"), F.sum("length").cast("long").alias("fill"),
    ).select(
        "container_id", F.col("_items.doc_id").alias("doc_ids"), F.col("_items.piece").alias("pieces"), F.transform("_items.piece", lambda p: p * capacity).alias("first_tokens"),
        "fill", (F.lit(capacity) - F.col("fill")).alias("room"),
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, least_containers, fill_share) of the result of `containers`."""
    total = packed.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"))
    return total.select(
        "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.round(F.col("n_tokens") / F.nullif(F.col("n_containers") * capacity, F.lit(0)), 6).alias("fill_share"),
    )
