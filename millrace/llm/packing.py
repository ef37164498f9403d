"""Filling fixed-capacity containers: shortest-pack-first over the length histogram.

Only the histogram of lengths (at most `capacity` rows) reaches the driver. Lengths are placed longest first; each goes
to the open packs with most room, whole groups of equal packs at a time, so the work depends on the number of distinct
lengths and patterns, not of documents. The patterns with their counts say which ranks of each length go to which
containers; documents are ranked within their length and joined to these spans. A length that a third of all documents
have is ranked in parts of about SLICE_ROWS.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from millrace.session import broadcastable, written

#: Documents of one length that are ranked by one task: each length is cut into as many parts as the most frequent needs.
SLICE_ROWS = 250_000
SPAN_SCHEMA = "spec_id int, length bigint, block bigint, low bigint, high bigint, base bigint, per bigint"


@dataclass(eq=False)
class Pattern:
    """A pack's lengths as a chain: this length `times` times, on top of `below`."""

    length: int
    times: int
    below: Pattern | None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern, int]]:
    """(count, pattern, room left) of all packs for the counts of lengths 1..capacity.

    Where no open pack takes a length, only as many new packs are opened as its documents fill.
    """
    groups: dict[int, list[tuple[int, Pattern | None]]] = {}
    rooms: list[int] = []  # negative rooms, as a heap; each room of groups once

    def put(room: int, count: int, pattern: Pattern | None) -> None:
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((count, pattern))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:  # no open pack takes it: new ones
                put(capacity, -(-left // (capacity // length)), None)
                room = capacity
            count, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room]
                heapq.heappop(rooms)
            used = min(count, left)
            if used < count:
                put(room, count - used, pattern)
            if pattern is not None and pattern.length == length:
                pattern = Pattern(length, pattern.times + 1, pattern.below)
            else:
                pattern = Pattern(length, 1, pattern)
            put(room - length, used, pattern)
            left -= used
    return [(count, pattern, room) for room, found in groups.items() for count, pattern in found if pattern is not None]


def spans(packs: list[tuple[int, Pattern, int]], spec_id: int) -> tuple[list[tuple], int]:
    """(spec_id, length, low, high, base, per): documents of that length with rank in [low, high) go to container
    base + (rank - low) // per; and the number of containers."""
    used: dict[int, int] = {}
    out, base = [], 0
    for count, pattern, _ in packs:
        step: Pattern | None = pattern
        while step is not None:
            low = used.get(step.length, 0)
            used[step.length] = low + count * step.times
            out.append((spec_id, step.length, low, used[step.length], base, step.times))
            step = step.below
        base += count
    return out, base


def _ranked(items: DataFrame, slices: int) -> DataFrame:
    """items (spec_id, length, doc_id, ...) with rank from 0 within spec_id and length."""
    items = items.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    sizes = items.groupBy("spec_id", "length", "slice").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("spec_id", "length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("spec_id", "length", "slice", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("spec_id", "length", "slice").orderBy("doc_id")
    return items.join(sizes, ["spec_id", "length", "slice"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("_base")).drop("_base", "slice")


def pack(sizes: DataFrame, specs: dict[int, int], slices: int | None = None) -> DataFrame:
    """spec_id, container_id, doc_id, piece_no, start_token, piece_tokens: every document in containers of every spec.

    sizes: doc_id, n_tokens. specs: capacity (at least 1) by spec_id. A document longer than the capacity fills
    containers of its own, one after the other; only what is left over is packed with others. A document of 0 tokens
    (null or empty text) takes no room and is put into some container (number 0 if there is none). Null sizes count as
    0. Container ids count from 0 within a spec, without gaps. Repeated doc_ids are documents of their own.
    """
    spark = sizes.sparkSession
    sizes = written(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")), "sizes")
    caps = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in sorted(specs.items())]))
    every = sizes.select("doc_id", "n_tokens", caps.alias("s")).select("doc_id", "n_tokens", "s.spec_id", "s.capacity")
    every = every.withColumn("full", F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("bigint"))
    every = every.withColumn("length", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    counts: dict[int, dict[int, int]] = {s: {} for s in specs}
    for r in every.where("length > 0").groupBy("spec_id", "length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most the sum of the capacities
        counts[r.spec_id][r.length] = r.n
    parts = lambda n: slices or max(8, -(-n // SLICE_ROWS))
    ranks, longs = parts(max((n for c in counts.values() for n in c.values()), default=0)), parts(max((sum(c.values()) for c in counts.values()), default=0))
    rows, made = [], {}
    widths: list[tuple[int, int, int]] = []
    for spec_id, capacity in sorted(specs.items()):
        own, made[spec_id] = spans(plan(counts[spec_id], capacity), spec_id)
        number: dict[int, int] = {}
        for x in own:
            number[x[1]] = number.get(x[1], 0) + 1
        width = {length: max(1, counts[spec_id][length] // n) for length, n in number.items()}
        widths += [(spec_id, length, w) for length, w in width.items()]
        # A span is entered under each block of ranks that it meets, so that the join is on equal blocks.
        for s, length, low, high, base, per in own:
            w = width[length]
            rows += [(s, length, block, low, high, base, per) for block in range(low // w, (high - 1) // w + 1)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["spec_id", "length", "block", "low", "high", "base", "per"]), SPAN_SCHEMA) if rows else spark.createDataFrame([], SPAN_SCHEMA)
    width = spark.createDataFrame(widths, "spec_id int, length bigint, width bigint")
    ranked = _ranked(every.where("length > 0"), ranks).join(F.broadcast(width), ["spec_id", "length"]).withColumn("block", F.floor(F.col("rank") / F.col("width")))
    table = F.broadcast(table) if broadcastable(table) else table
    packed = ranked.join(table, ["spec_id", "length", "block"]).where("rank >= low and rank < high")
    packed = packed.select("spec_id", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("per"))).alias("container_id"), "doc_id", (F.col("full") + 1).alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("length").alias("piece_tokens"))

    pick = lambda values: F.element_at(F.map_from_arrays(F.array(*[F.lit(s).cast("int") for s in sorted(specs)]), F.array(*[F.lit(values[s]).cast("bigint") for s in sorted(specs)])), F.col("spec_id"))
    # Full pieces are numbered after the packed containers, by running sums in slices.
    long = every.where("full > 0").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(longs)))
    sums = long.groupBy("spec_id", "slice").agg(F.sum("full").alias("_n"))
    over = Window.partitionBy("spec_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("spec_id", "slice", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    before = Window.partitionBy("spec_id", "slice").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    long = long.join(sums, ["spec_id", "slice"]).withColumn("_at", F.col("_base") + F.coalesce(F.sum("full").over(before), F.lit(0)) + pick(made))
    whole = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    whole = whole.select("spec_id", (F.col("_at") + F.col("k")).alias("container_id"), "doc_id", (F.col("k") + 1).alias("piece_no"), (F.col("k") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("piece_tokens"))
    none = every.where("n_tokens = 0").select("spec_id", F.pmod(F.xxhash64("doc_id"), F.greatest(pick(made), F.lit(1))).alias("container_id"), "doc_id", F.lit(1).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("piece_tokens"))
    return packed.unionByName(whole).unionByName(none)
