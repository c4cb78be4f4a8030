"""Continuous periods and gaps of overlapping half-open intervals.

Method: dyadic blocks. The integer intervals of a chunk of groups are decomposed into
canonical dyadic blocks, blocks under an ancestor that is present are removed, pairs of
siblings are merged upward, and what is left is read off in order, adjacent blocks
coalescing to periods. Endpoints are first replaced by their ranks among the chunk's
(group, endpoint) pairs: that keeps order and touching, makes the universe as small as
the chunk, and lets one pass of array operations serve many groups at once (the unit
behind a group's last endpoint is never covered, so groups can't merge).

Hot groups (found by sketch) are cut at coarse dyadic cells first, so that one group's
rows are spread over many tasks: what lies inside a cell is solved per group and cell;
whole cells inside an interval become coarse canonical blocks, and a cell under a coarse
block is recognised by an equi-join on its dyadic ancestors. Only one span per cell goes
to the last step, which is bounded by the number of cells, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.heavy import heavy_keys
from claimweave.plans.runtime import Scratch, sorted_numbering

OPEN = 1 << 62  # stands for an open end; real values lie strictly inside (-OPEN, OPEN)
TOP = 63


def dyadic_union(lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal periods of integer intervals [lo, hi) inside [0, size), ascending."""
    levels = max(1, int(size - 1).bit_length()) + 1
    left, right = lo.copy(), hi.copy()
    present: list[np.ndarray] = []
    for level in range(levels):
        here = np.zeros((1 << (levels - 1)) >> level, bool)
        live = left < right
        pick = live & (left & 1 == 1)
        here[left[pick]] = True
        left = left + pick
        pick = (left < right) & (right & 1 == 1)
        right = right - pick
        here[right[pick]] = True
        present.append(here)
        left, right = left >> 1, right >> 1
        if level == levels - 1:
            break
        left, right = np.minimum(left, right), right
    above = present[-1].copy()  # blocks that are present or lie under one that is
    for level in range(levels - 2, -1, -1):
        covered = np.repeat(above, 2)
        above = present[level] | covered
        present[level] &= ~covered
    for level in range(levels - 1):
        pair = present[level][0::2] & present[level][1::2]
        present[level] &= ~np.repeat(pair, 2)
        present[level + 1] |= pair
    starts, ends = [], []
    for level, here in enumerate(present):
        ix = np.flatnonzero(here)
        starts.append(ix << level)
        ends.append((ix + 1) << level)
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    first = np.ones(len(start), bool)
    first[1:] = start[1:] != end[:-1]
    last = np.ones(len(start), bool)
    last[:-1] = first[1:]
    return start[first], end[last]


def solve_groups(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods of many groups at once: group, lo, hi; ``group`` ascending integers."""
    ends = np.concatenate([lo, hi])
    both = np.concatenate([group, group])
    order = np.lexsort((ends, both))
    g, v = both[order], ends[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    rank = np.empty(len(g), np.int64)
    rank[order] = np.cumsum(new) - 1
    n = len(lo)
    a, b = dyadic_union(rank[:n], rank[n:], int(new.sum()))
    g, v = g[new], v[new]
    return g[a], v[a], v[b]


def _sweep(keys: list[str], spans: bool, chunk_rows: int = 200_000):
    """mapInArrow function over rows sorted by ``keys`` and ``lo``: gaps inside each group and, if asked, its outer span.

    Holds ``chunk_rows`` rows and a batch, whatever the size of a group.
    """

    def solve(t: pa.Table, origin: int | None = None, closing: bool = True):
        """Gaps (and spans) of the table's groups, and its last period.

        ``origin``: where the first group began, if earlier rows of it are gone;
        ``closing`` false: the last group goes on, so its span is not known yet.
        """
        n = t.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            code = t[k].combine_chunks()
            code = code.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        first_row = np.flatnonzero(new)
        g, lo, hi = solve_groups(np.cumsum(new) - 1, t["lo"].to_numpy(), t["hi"].to_numpy())
        same = g[1:] == g[:-1]
        parts = [(first_row[g[1:][same]], hi[:-1][same], lo[1:][same], "gap")]
        if spans and closing:
            head = np.ones(len(g), bool)
            head[1:] = ~same
            tail = np.ones(len(g), bool)
            tail[:-1] = ~same
            start = lo[head]
            if origin is not None:
                start[0] = origin
            parts.append((first_row[g[head]], start, hi[tail], "span"))
        out = []
        for rows, a, b, kind in parts:
            part = t.select(keys).take(pa.array(rows))
            part = part.append_column("kind", pa.array([kind] * len(rows), pa.string()))
            out.append(part.append_column("lo", pa.array(a)).append_column("hi", pa.array(b)))
        return out, (int(lo[0]), int(lo[-1]), int(hi[-1]))

    def cut(t: pa.Table) -> int:
        """Row where the last group begins."""
        n = t.num_rows
        at = 0
        for k in keys:
            code = t[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            other = np.flatnonzero(code != code[-1])
            at = max(at, int(other[-1]) + 1 if len(other) else 0)
        return min(at, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count, origin = 0, None
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                count += b.num_rows
            if count < chunk_rows:
                continue
            t = pa.concat_tables(held).combine_chunks()
            at = cut(t)
            if at:
                for part in solve(t.slice(0, at), origin)[0]:
                    yield from part.to_batches()
                rest, origin = t.slice(at), None
            else:
                # one group fills the chunk; rows come by lo, so all its periods but the last are closed
                parts, (begin, lo, hi) = solve(t, closing=False)
                for part in parts:
                    yield from part.to_batches()
                origin = begin if origin is None else origin
                rest = t.select(keys).slice(0, 1).append_column("lo", pa.array([lo])).append_column("hi", pa.array([hi]))
            held, count = [rest], rest.num_rows
        if count:
            for part in solve(pa.concat_tables(held).combine_chunks(), origin)[0]:
                yield from part.to_batches()

    return run


def gaps(df: DataFrame, keys: list[str], cell_bits: int, lo: str = "lo", hi: str = "hi", hot_share: float = 0.005) -> DataFrame:
    """Gaps between the continuous periods of each group: ``keys..., gap_lo, gap_hi``.

    ``lo`` and ``hi`` are longs, null is an open end; half-open, touching intervals
    continue each other. ``cell_bits``: hot groups are cut at multiples of 2**cell_bits.

    Defined cases: lo >= hi covers nothing; rows with a null key are left out; a group
    with one period or none has no gap; repeated rows change nothing; extra columns are
    ignored; an empty table gives no rows.
    """
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(
        *keys, F.coalesce(lo, F.lit(-OPEN)).alias("lo"), F.coalesce(hi, F.lit(OPEN)).alias("hi")
    ).where("lo < hi")
    scratch = Scratch(df.sparkSession, "periods")
    tag = F.xxhash64(*keys).alias("_group")
    # hot: more than a quarter of a task's fair share; a false positive only costs a cut
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = heavy_keys(rows.select(tag), "_group", min(hot_share, 1 / (4 * n)), max(512, min(4 * n, 100_000)))
    tagged = rows.select("*", tag).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_group", "left")
    one, cl, ch = F.lit(1).cast("long"), F.expr(f"shiftright(lo, {cell_bits})"), F.expr(f"shiftright(hi - 1, {cell_bits})")
    tagged = tagged.withColumns({"_cl": cl, "_ch": ch}).drop("_group")
    size = 1 << cell_bits
    left_whole, right_whole = F.col("lo") == F.col("_cl") * size, F.col("hi") == (F.col("_ch") + 1) * size
    piece = lambda cell, a, b: F.struct(cell.alias("cell"), a.alias("lo"), b.alias("hi"))
    none = F.lit(None).cast("long")
    pieces = (
        F.when(F.col("_hot").isNull(), F.array(piece(none, F.col("lo"), F.col("hi"))))
        .when(F.col("_cl") == F.col("_ch"), F.array(piece(F.col("_cl"), F.col("lo"), F.col("hi"))))
        .otherwise(
            F.array(
                piece(F.col("_cl"), F.col("lo"), (F.col("_cl") + 1) * size),
                piece(F.col("_ch"), F.col("_ch") * size, F.col("hi")),
            )
        )
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    fine = tagged.select(*keys, F.inline(pieces))
    fine = fine.repartition(n, *keys, "cell").sortWithinPartitions(*keys, "cell", "lo")
    solved = scratch.keep(fine.mapInArrow(_sweep([*keys, "cell"], True), f"{schema}, cell long, kind string, lo long, hi long"))
    plain = solved.where("cell is null and kind = 'gap'")
    # whole cells inside hot intervals, as canonical dyadic blocks of cell numbers
    middle = (
        tagged.where("_hot and _ch - _cl > 1").select(*keys, (F.col("_cl") + 1).alias("a"), F.col("_ch").alias("b")).distinct()
    )
    blocks = middle.select(*keys, "a", "b", F.explode(canonical_blocks("a", "b")).alias("k")).select(*keys, "k.level", "k.ix").distinct()
    cells = solved.where("cell is not null").select(*keys, "cell").distinct()
    ancestors = cells.select(*keys, "cell", F.explode(F.sequence(F.lit(0), F.lit(TOP - cell_bits))).alias("level"))
    ancestors = ancestors.withColumn("ix", F.expr("shiftright(cell, level)"))
    covered = ancestors.join(blocks, [*keys, "level", "ix"], "left_semi").select(*keys, "cell").distinct()
    inner = solved.where("cell is not null").join(covered, [*keys, "cell"], "left_anti")
    spans = inner.where("kind = 'span'").select(*keys, "lo", "hi").unionByName(
        blocks.select(
            *keys,
            F.expr(f"shiftleft(greatest(shiftleft(ix, level), -shiftleft(1L, {TOP - 1 - cell_bits})), {cell_bits})").alias("lo"),
            F.expr(f"shiftleft(least(shiftleft(ix + 1, level), shiftleft(1L, {TOP - 1 - cell_bits})), {cell_bits})").alias("hi"),
        )
    )
    outer = spans.repartition(n, *keys).sortWithinPartitions(*keys, "lo").mapInArrow(
        _sweep(keys, False), f"{schema}, kind string, lo long, hi long"
    )
    parts = [x.select(*keys, F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi")) for x in (plain, inner.where("kind = 'gap'"), outer)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def canonical_blocks(a: str, b: str):
    """Array of (level, ix): the canonical dyadic blocks of the integers [a, b), as an expression."""
    step = F.aggregate(
        F.sequence(F.lit(0), F.lit(TOP)),
        F.struct(F.col(a).alias("l"), F.col(b).alias("r"), F.expr("cast(array() as array<struct<level:int,ix:bigint>>)").alias("out")),
        lambda s, k: F.when(s["l"] >= s["r"], s).otherwise(
            F.struct(
                F.shiftright(s["l"] + s["l"].bitwiseAND(F.lit(1)), 1).alias("l"),
                F.shiftright(s["r"], 1).alias("r"),
                F.concat(
                    s["out"],
                    F.when(s["l"].bitwiseAND(F.lit(1)) == 1, F.array(F.struct(k.alias("level"), s["l"].alias("ix"))))
                    .otherwise(F.expr("cast(array() as array<struct<level:int,ix:bigint>>)")),
                    F.when(
                        (s["r"].bitwiseAND(F.lit(1)) == 1) & (s["r"] - 1 >= s["l"] + s["l"].bitwiseAND(F.lit(1))),
                        F.array(F.struct(k.alias("level"), (s["r"] - 1).alias("ix"))),
                    ).otherwise(F.expr("cast(array() as array<struct<level:int,ix:bigint>>)")),
                ).alias("out"),
            )
        ),
        lambda s: s["out"],
    )
    return step


def periods_from_gaps(df: DataFrame, found: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Continuous periods ``keys..., period_lo, period_hi``: the hull of a group cut at its ``gaps``; open ends are null again.

    Over all groups in order, the k-th start and the k-th end belong to one period, as a
    group has as many of either. Both are numbered by sampled ranges and meet by number,
    so a group of any size is spread over tasks.
    """
    scratch = Scratch(df.sparkSession, "periods")
    hull = (
        df.where(" and ".join(f"`{k}` is not null" for k in keys))
        .select(*keys, F.coalesce(lo, F.lit(-OPEN)).alias("lo"), F.coalesce(hi, F.lit(OPEN)).alias("hi")).where("lo < hi")
        .groupBy(*keys).agg(F.min("lo").alias("period_lo"), F.max("hi").alias("period_hi"))
    )
    hull, found = scratch.keep(hull), scratch.keep(found)
    starts = hull.select(*keys, F.col("period_lo").alias("p")).unionByName(found.select(*keys, F.col("gap_hi").alias("p")))
    ends = hull.select(*keys, F.col("period_hi").alias("q")).unionByName(found.select(*keys, F.col("gap_lo").alias("q")))
    starts = sorted_numbering(starts, [*keys, "p"], scratch)
    ends = sorted_numbering(ends, [*keys, "q"], scratch).select("ix", "q")
    return starts.join(ends, "ix").select(
        *keys, F.when(F.col("p") > -OPEN, F.col("p")).alias("period_lo"), F.when(F.col("q") < OPEN, F.col("q")).alias("period_hi")
    )
