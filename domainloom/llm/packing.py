"""Packing items into containers of fixed capacity by linear grouping.

Lengths are integers up to the capacity, so all that matters of the items is how
many there are of each length.  The driver plans on that histogram: it rounds the
large lengths up to a few sizes (equal-cardinality groups), finds configurations
of those sizes by linear programming with knapsack pricing, puts the actual
lengths into the configurations' slots, and fills what is left with the small
lengths by best fit.  Containers are handled in runs of equal ones, so the plan's
size depends on the capacity and the number of groups, never on the number of
items.  The executors then number the items of each length and look their
containers up.
"""

from __future__ import annotations

import logging
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import number_rows
from ..session import stage
from .tokens import token_count

GROUPS = 64
SMALL_SHARE = 1 / 4
#: Units that the programs measure a container in; larger capacities are planned in coarser units, lengths rounded up.
UNITS = 16_384


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400, gap: float = 2e-4) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Few-size configurations ``(items per size, containers)`` that cover ``demand``, and how far they may be above the least number of containers.

    A linear program over all configurations, solved by column generation: the
    dual prices of the sizes go to an unbounded knapsack, whose best filling
    replaces a configuration as long as it lowers the cost by more than ``gap``.  The
    second result is the share by which the number may still exceed the program's
    least one; above ``gap`` where ``rounds`` did not do.  A round takes at most
    ``UNITS`` steps, whatever the capacity.
    """
    g = len(sizes)
    unit = -(-capacity // UNITS)
    capacity = capacity // unit
    sizes = np.minimum(-(-sizes // unit), capacity)
    left = np.inf
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand
    for turn in range(rounds):
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        last = np.full(capacity + 1, -1)
        useful = np.flatnonzero(price > 1e-12)
        if not len(useful):
            left = 0.0
            break
        s, p = sizes[useful], price[useful]
        for c in range(int(s.min()), capacity + 1):
            n = np.searchsorted(s, c, side="right")  # sizes ascend
            values = best[c - s[:n]] + p[:n]
            i = int(values.argmax()) if n else -1
            if n and values[i] > best[c - 1]:
                best[c], last[c] = values[i], useful[i]
            else:
                best[c] = best[c - 1]
        left = best[capacity] - 1
        if left <= gap:
            break
        column, c = np.zeros(g), capacity
        while c > 0:
            if best[c] == best[c - 1]:
                c -= 1
                continue
            column[last[c]] += 1
            c -= int(sizes[last[c]])
        step = inverse @ column
        ratio = np.where(step > 1e-10, amount / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ demand, 0)
    return [(basis[:, i].astype(np.int64), float(amount[i])) for i in range(g) if amount[i] > 1e-9], max(float(left), 0.0)


@dataclass
class Plan:
    """Which container the n-th item of a length goes to: ``first + (n - start) // each`` for n in [start, start + items)."""

    capacity: int
    containers: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, start, items, each, first
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # residual -> runs (first, containers)
    residuals: list[int] = field(default_factory=list)  # sorted keys of free
    used: dict[int, int] = field(default_factory=dict)  # length -> items placed
    gap: float = 0.0  # share by which the configurations may exceed the least number of containers

    def open(self, n: int) -> int:
        self.containers += n
        return self.containers - n

    def release(self, residual: int, first: int, n: int) -> None:
        if residual <= 0 or n <= 0:
            return
        if residual not in self.free:
            self.free[residual] = []
            insort(self.residuals, residual)
        self.free[residual].append((first, n))

    def place(self, length: int, items: int, each: int, first: int) -> None:
        start = self.used.get(length, 0)
        self.rows.append((length, start, items, each, first))
        self.used[length] = start + items

    def best_fit(self, length: int, items: int) -> None:
        """Puts ``items`` items of one length into the tightest containers that take them, whole runs at a time."""
        while items > 0:
            at = bisect_left(self.residuals, length)
            if at < len(self.residuals):
                residual = self.residuals[at]
                first, n = self.free[residual].pop()
                if not self.free[residual]:
                    del self.free[residual]
                    self.residuals.pop(at)
            else:
                residual = self.capacity
                n = -(-items // (residual // length))
                first = self.open(n)
            each = residual // length
            full = min(n, items // each)
            if full:
                self.place(length, full * each, each, first)
                self.release(residual - each * length, first, full)
                items -= full * each
            if full < n and items > 0:
                # fewer than ``each`` items are left: one container takes them
                self.place(length, items, items, first + full)
                self.release(residual - items * length, first + full, 1)
                full, items = full + 1, 0
            self.release(residual, first + full, n - full)


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> Plan:
    """The packing of ``histogram`` (length -> items, lengths from 1 to ``capacity``)."""
    out = Plan(capacity)
    counts = {length: n for length, n in histogram.items() if n > 0}
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    if n := counts.pop(capacity, 0):
        out.place(capacity, n, 1, out.open(n))
    large = sorted((length for length in counts if length > capacity * small_share), reverse=True)
    if large:
        _configure(out, {length: counts[length] for length in large}, groups)
    for length in sorted((x for x in counts if x <= capacity * small_share), reverse=True):
        out.best_fit(length, counts[length])
    return out


def _configure(out: Plan, counts: dict[int, int], groups: int) -> None:
    """Linear grouping, configurations, and the actual lengths in their slots."""
    lengths = np.array(sorted(counts, reverse=True))
    number = np.array([counts[x] for x in lengths])
    ends = np.cumsum(number)
    # a group ends where its share of the items is reached; equal lengths stay together
    group = np.minimum((ends - number) * groups // ends[-1], groups - 1)
    members = [np.flatnonzero(group == x) for x in np.unique(group)]
    size = np.array([lengths[m].max() for m in members])
    demand = np.array([number[m].sum() for m in members], dtype=float)
    ascending = np.argsort(size)
    chosen, out.gap = configurations(size[ascending], demand[ascending], out.capacity)
    if out.gap > 1e-3:
        logging.getLogger(__name__).warning("containers of %d: up to %.2f %% more than the configurations need", out.capacity, 100 * out.gap)
    # remaining items of each group, longest first, as [length, number]
    left = [[[int(lengths[i]), int(number[i])] for i in m] for m in members]
    for content, amount in sorted(chosen, key=lambda x: -x[1]):
        times = int(amount)
        slots = [g for place, g in enumerate(ascending) for _ in range(int(content[place]))]
        for g in set(slots):  # rounding of the program must not ask for more than there is
            times = min(times, sum(n for _, n in left[g]) // slots.count(g))
        if times <= 0:
            continue
        first = out.open(times)
        room = np.array([[0, times, out.capacity]], dtype=np.int64)  # runs: from, to, residual
        for g in slots:
            at = 0
            while at < times:
                length, n = left[g][0]
                take = min(n, times - at)
                out.place(length, take, 1, first + at)
                room = _split(room, at, at + take, length)
                at += take
                left[g][0][1] -= take
                if left[g][0][1] == 0:
                    left[g].pop(0)
        for start, end, residual in room:
            out.release(int(residual), first + int(start), int(end - start))
    rest = sorted(((length, n) for g in left for length, n in g if n), reverse=True)
    for length, n in rest:
        out.best_fit(length, n)


def _split(room: np.ndarray, start: int, end: int, length: int) -> np.ndarray:
    """Runs of containers with ``length`` taken from those in [start, end)."""
    out = []
    for a, b, residual in room:
        for x, y in ((a, min(b, start)), (max(a, start), min(b, end)), (max(a, end), b)):
            if x < y:
                out.append((x, y, residual - length if start <= x < end else residual))
    return np.array(out, dtype=np.int64)


def pack(items: DataFrame, capacities: dict[str, int], length_col: str = "tokens", id_col: str = "doc_id", groups: int = GROUPS) -> DataFrame:
    """``capacity_name, container, id_col, piece, start, tokens``: every item in a container of every capacity.

    An item is divided only if it exceeds the capacity: into full pieces and one
    rest, numbered from 0 with their ``start`` within the item.  Items without
    length are listed in container 0 with 0 tokens.  Null lengths count as 0;
    negative ones are an error of the caller.  Repeated ids are separate items.
    """
    spark = items.sparkSession
    names = sorted(capacities)
    # one row per capacity: a fixed report table
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(int(capacities[c])).cast("bigint").alias("cap")) for i, c in enumerate(names)]))
    length = F.coalesce(F.col(length_col), F.lit(0)).cast("bigint")
    sized = items.select(F.col(id_col), length.alias("_n"), kinds.alias("_c")).select(id_col, "_n", F.col("_c.i").alias("_i"), F.col("_c.cap").alias("_cap"))
    last = F.greatest(F.floor((F.col("_n") - 1) / F.col("_cap")), F.lit(0)).cast("bigint")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        id_col, "piece", (F.col("piece") * F.col("_cap")).alias("start"),
        F.least(F.col("_n") - F.col("piece") * F.col("_cap"), F.col("_cap")).alias("tokens"), "_i",
    )
    keyed = stage(pieces.withColumn("_key", F.col("_i").cast("bigint") * F.lit(2**40) + F.col("tokens")))
    # at most one row per capacity and length
    histograms: dict[int, dict[int, int]] = {}
    for i, t, n in keyed.groupBy("_i", "tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        if t > 0:
            histograms.setdefault(i, {})[t] = n
    keys, starts, each, first = [], [], [], []
    for i, name in enumerate(names):
        rows = sorted(plan(histograms.get(i, {}), int(capacities[name]), groups).rows)
        keys += [i * 2**40 + r[0] for r in rows]
        starts += [r[1] for r in rows]
        each += [r[3] for r in rows]
        first += [r[4] for r in rows]
    tables = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64) for x in (keys, starts, each, first)))
    numbered = number_rows(keyed, "_key", "_number")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, each, first = tables.value
        bounds: dict[int, tuple[int, int]] = {}
        for batch in batches:
            key, number, tokens = (batch.column(c).to_numpy() for c in ("_key", "_number", "tokens"))
            container = np.zeros(len(key), dtype=np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for rows in np.split(order, cuts):
                if not len(rows) or tokens[rows[0]] == 0:
                    continue
                k = key[rows[0]]
                if k not in bounds:
                    bounds[k] = (int(np.searchsorted(keys, k, side="left")), int(np.searchsorted(keys, k, side="right")))
                lo, hi = bounds[k]
                at = lo + np.searchsorted(starts[lo:hi], number[rows], side="right") - 1
                container[rows] = first[at] + (number[rows] - starts[at]) // each[at]
            named = pa.array(np.array(names, dtype=object)[batch.column("_i").to_numpy()] if len(key) else [], pa.string())
            # ids stay in Arrow, whatever their type
            yield pa.RecordBatch.from_arrays([named, pa.array(container), *(batch.column(c) for c in (id_col, "piece", "start", "tokens"))], names=["capacity_name", "container", id_col, "piece", "start", "tokens"])

    kinds = {f.name: f for f in numbered.schema.fields}
    out = [T.StructField("capacity_name", T.StringType()), T.StructField("container", T.LongType()), *(kinds[c] for c in (id_col, "piece", "start", "tokens"))]
    return numbered.mapInArrow(look_up, T.StructType(out))


def pack_documents(documents: DataFrame, capacities: dict[str, int], vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` of texts measured in tokens of the vocabulary."""
    return pack(documents.select(id_col, token_count(F.col(text_col), vocab).alias("tokens")), capacities, "tokens", id_col)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per capacity: items, pieces, tokens, containers, the least possible number of containers, and the share filled."""
    cap = F.element_at(F.create_map(*[F.lit(x) for c in capacities.items() for x in c]), F.col("capacity_name")).cast("bigint")
    used = packed.where(F.col("tokens") > 0).groupBy("capacity_name", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return used.groupBy("capacity_name").agg(
        F.sum("n").cast("bigint").alias("pieces"), F.sum("t").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("t").alias("fullest"),
    ).select("*", F.ceil(F.col("tokens") / cap).alias("least"), F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("filled"))
