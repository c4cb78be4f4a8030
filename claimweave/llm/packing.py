"""Texts packed into containers of a fixed number of tokens.

Method: configuration linear program over the histogram of lengths. A configuration is
a multiset of lengths that fits one container; the program asks for the fewest
containers that cover the histogram. Its dual prices come from multiplicative weights:
lengths covered less so far weigh more, and the configuration of greatest weight comes
from a knapsack dynamic program over the capacity. Rounding goes on with the same
pricing, but uses configurations whole times until about four containers' worth of items
is left, at every size of input; only those go by best fit. The histogram has at most one
entry per length up to the capacity, so this part is nearly as large for any corpus.

Texts meet their containers without moving: the items of one length are numbered (range
partitioning, so a length that most texts share is spread out), and the numbers of a
length are dealt to the configurations by a small broadcast table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.plans.runtime import Scratch, sorted_numbering

# Fixed value: the word pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _count(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            texts = b.column(2).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "version", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, version, n_tokens`` of every row; ``version`` is a hash of the text. Null texts count 0."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    docs.sparkSession.sparkContext.addFile(vocabulary)  # executors needn't have it
    return rows.mapInArrow(_count(os.path.basename(vocabulary), pattern), "doc_id long, version long, n_tokens long")


def price(sizes: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the capacity: greatest weight of a multiset of at most c tokens, and the index of one of its items (-1: none)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        v, k = value[c - 1], ends[c]
        if k:
            got = weight[:k] + value[c - sizes[:k]]
            j = int(got.argmax())
            if got[j] > v:
                v, last[c] = got[j], j
        value[c] = v
    return value, last


def configuration(last: np.ndarray, sizes: np.ndarray, j: int, capacity: int) -> dict[int, int]:
    """The heaviest configuration that holds item ``j``, read off the knapsack table: {index: copies}."""
    out, c = {j: 1}, capacity - int(sizes[j])
    while c > 0:
        k = int(last[c])
        if k < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= int(sizes[k])
    return out


def bounded_configuration(sizes: np.ndarray, weight: np.ndarray, limit: np.ndarray, capacity: int) -> dict[int, int]:
    """The heaviest configuration with at most ``limit`` copies of each item (knapsack over binary parts)."""
    parts = []
    for j, size in enumerate(sizes.tolist()):
        left, k = min(int(limit[j]), capacity // size), 1
        while left > 0:
            parts.append((j, min(k, left)))
            left, k = left - k, 2 * k
    value, took = np.zeros(capacity + 1), np.zeros((len(parts), capacity + 1), bool)
    for i, (j, k) in enumerate(parts):
        room = k * int(sizes[j])
        if room <= capacity:
            other = value[: capacity + 1 - room] + k * weight[j]
            better = other > value[room:]
            took[i, room:] = better
            value[room:][better] = other[better]
    out, c = {}, capacity
    for i in range(len(parts) - 1, -1, -1):
        if took[i, c]:
            j, k = parts[i]
            out[j] = out.get(j, 0) + k
            c -= k * int(sizes[j])
    return out


def learn_prices(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 200, slack: float = 0.02, batch: int = 32, eta: float = 1.0) -> tuple[np.ndarray, float]:
    """Dual prices per size by multiplicative weights, and the lower bound on containers they prove.

    A size weighs its volume times exp(-eta * how much of it is covered so far). Each
    round prices by knapsack, takes the configurations of the least covered sizes that are
    within ``slack`` of the best, and averages the weights; the best of both counts. Any weights divided by their
    best configuration are a feasible dual solution, so each gives a bound.
    """
    cover, average = np.zeros(len(sizes)), np.zeros(len(sizes))
    best, bound = sizes / capacity, float((sizes * counts).sum()) / capacity
    for r in range(rounds):
        weight = sizes * np.exp(-eta * (cover - cover.min()))
        weight = weight / weight.max()
        value, last = price(sizes, weight, capacity)
        average += weight / value[capacity]
        tried = [(weight, value[capacity])]
        if r % 20 == 19:
            tried.append((average, price(sizes, average, capacity)[0][capacity]))
        for prices, top in tried:
            if (prices * counts).sum() / top > bound:
                bound, best = float((prices * counts).sum() / top), prices / top
        good = np.flatnonzero(weight + value[capacity - sizes] >= (1 - slack) * value[capacity])
        for j in good[np.argsort(cover[good], kind="stable")][:batch].tolist():
            ix, n = (np.array(x) for x in zip(*configuration(last, sizes, j, capacity).items()))
            cover[ix] += float((counts[ix] / n).min()) / 8 * n / counts[ix]
    return best, bound


def round_program(
    sizes: np.ndarray, counts: np.ndarray, capacity: int, prices: np.ndarray, eta: float = 1.0, slack: float = 0.01,
    steps: int = 8, batch: int = 64, residue: int = 4,
) -> tuple[dict[tuple[tuple[int, int], ...], int], np.ndarray]:
    """Whole containers per configuration, and the few items left over (``residue`` containers' worth at most).

    Rounding keeps the program running: prices times exp(eta * share of a size still
    there) are priced by knapsack, and the configurations of the sizes that lag most are
    used whole times, an eighth of what is left of their scarcest size at once, and at
    least once. Prices are tilted a little towards long items, which are harder to place.
    So the work follows the number of sizes and the logarithm of the counts.
    """
    left, made = counts.copy(), {}
    while (left * sizes).sum() > residue * capacity:
        live = np.flatnonzero(left > 0)
        s, r = sizes[live], left[live]
        share = r / counts[live]
        weight = (prices[live] * (1 + s / (10 * capacity)) + s / (1000 * capacity)) * np.exp(eta * (share - share.max()))
        value, last = price(s, weight, capacity)
        order = np.lexsort((-s, -share))
        order = order[(weight + value[capacity - s])[order] >= (1 - slack) * value[capacity]][:batch]
        fitting = (configuration(last, s, j, capacity) for j in order.tolist())
        used = 0
        for config in fitting:
            if all(r[k] >= n for k, n in config.items()):
                used += _use(made, s, r, config, steps)
        if not used:
            _use(made, s, r, bounded_configuration(s, weight, r, capacity), steps)
        left[live] = r
    return made, left


def _use(made: dict, sizes: np.ndarray, left: np.ndarray, config: dict[int, int], steps: int) -> int:
    ix, n = (np.array(x) for x in zip(*config.items()))
    times = max(1, int((left[ix] // n).min()) // steps)
    left[ix] -= times * n
    key = tuple(sorted(zip(sizes[ix].tolist(), n.tolist())))
    made[key] = made.get(key, 0) + times
    return times


def solve_histogram(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[int, dict[int, int]]]:
    """Containers to fill: (how many, {size: items each}), covering every count exactly."""
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    if not len(sizes):
        return []
    prices, _ = learn_prices(sizes, counts, capacity, rounds)
    plans = []
    for eta in (1.0, 4.0):  # the second is better where items are large, the first where they are small
        made, left = round_program(sizes, counts, capacity, prices, eta)
        for config in best_fit(sizes, left, capacity):
            made[config] = made.get(config, 0) + 1
        plans.append(made)
    return [(n, dict(config)) for config, n in min(plans, key=lambda made: sum(made.values())).items()]


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Items longest first, each into the fullest container that still takes it; contents as (size, items) pairs."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a container has room r
    held: list[dict[int, int]] = []
    for size, n in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
        for _ in range(n):
            fitting = rooms >> size
            if fitting:
                room = size + ((fitting & -fitting).bit_length() - 1)
                k = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, k = capacity, len(held)
                held.append({})
            held[k][size] = held[k].get(size, 0) + 1
            room -= size
            by_room[room].append(k)
            rooms |= 1 << room
    return [tuple(h.items()) for h in held]


def pack(items: DataFrame, capacity: int, rounds: int = 200) -> DataFrame:
    """``doc_id, version, piece, n_tokens, container`` for rows ``doc_id, version, n_tokens``.

    An item larger than the capacity is cut into full pieces, each alone in a container,
    and a rest that is packed like an item; no other item is split. Containers are
    numbered from 0; every piece has one.

    Defined cases: equal rows are one item; items of null or zero size have piece 0 and a
    null container; an empty table gives no rows.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    one = items.groupBy("doc_id", "version").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("n_tokens"))
    full = F.expr(f"n_tokens div {capacity}")
    pieces = F.when(
        F.col("n_tokens") > capacity,
        F.filter(
            F.transform(F.sequence(F.lit(0).cast("long"), full), lambda i: F.struct(i.alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - i * capacity).alias("size"))),
            lambda p: p["size"] > 0,
        ),
    ).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.col("n_tokens").alias("size"))))
    cut = one.select("doc_id", "version", F.inline(pieces))
    numbered = sorted_numbering(cut, ["size", "doc_id", "version", "piece"], scratch)
    # one entry per size, at most capacity + 1
    hist = {r["size"]: (r["n"], r["first"]) for r in numbered.groupBy("size").agg(F.count("*").alias("n"), F.min("ix").alias("first")).collect()}
    sizes = np.array(sorted(s for s in hist if s > 0), np.int64)
    plan = solve_histogram(sizes, np.array([hist[int(s)][0] for s in sizes], np.int64), capacity, rounds)
    dealt = {int(s): hist[int(s)][1] for s in sizes}
    table, base = [], 0
    for n, config in plan:
        for s, a in config.items():
            table.append((s, dealt[s], dealt[s] + n * a, base, a))
            dealt[s] += n * a
        base += n
    slots = spark.createDataFrame(pd.DataFrame(table, columns=["size", "lo", "hi", "base", "each"]).astype("int64")) if table else None
    if slots is None:
        return cut.select("doc_id", "version", "piece", F.col("size").alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    # slots: one row per configuration and size, bounded by sizes, steps and the logarithm of the counts
    # (125,000 rows for a million texts of 1,252 sizes, 5 MB)
    met = numbered.alias("i").join(F.broadcast(slots).alias("s"), F.expr("i.size = s.size and i.ix >= s.lo and i.ix < s.hi"), "left")
    return met.select(
        "doc_id", "version", "piece", F.col("i.size").alias("n_tokens"), F.expr("s.base + (i.ix - s.lo) div s.each").alias("container")
    )
