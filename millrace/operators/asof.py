"""Attributes as known at event time, by dyadic decomposition of the validity intervals.

Time is cut into leaves of 2**leaf_bits microseconds, counted from the first event; a node (level, index) covers
2**level leaves. Overlapping validity intervals are first cut by precedence into disjoint ones. Each interval, clipped to
the span of the events, becomes at most two nodes per level; an event equi-joins, on entity and node, the one node of each
level that encloses it. Exact half-open bounds are checked on the match, so leaves that an interval covers only in part do
no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ordered import with_neighbours
from millrace.session import BROADCAST_BYTES, cut, row_bytes

#: Nodes are broadcast up to this many bytes; beyond, both sides are shuffled on entity and node, in SALTS parts each, as a
#: hot entity's events share its upper nodes.
BROADCAST_NODES, SALTS = BROADCAST_BYTES, 16
#: A leaf is 2**32 microseconds, about 72 minutes.
LEAF_BITS = 32


def dyadic_nodes(versions: DataFrame, low: Column, high: Column, origin: int, leaf_bits: int, levels: int) -> DataFrame:
    """versions, one row per node of the cover of [low, high) (microseconds), with columns level and node.

    Only the span of 2**(levels-1) leaves from origin is covered; an interval outside it, or empty, gives no row.
    """
    top = 1 << (levels - 1)
    first = F.greatest(F.shiftright(low - origin, leaf_bits), F.lit(0))
    last = F.least(F.shiftright(high - 1 - origin, leaf_bits), F.lit(top - 1))  # inclusive
    out = versions.withColumn("_a", first).withColumn("_b", last + 1).where((low < high) & F.col("_a").__lt__(F.col("_b")))
    # At level k the cover holds the left-over odd block at either end of [ceil(a / 2^k), floor(b / 2^k)).
    one = F.lit(1).cast("bigint")

    def at(k: int) -> Column:
        ceil_a, floor_b = F.shiftright(F.col("_a") + ((1 << k) - 1), k), F.shiftright(F.col("_b"), k)
        node = lambda keep, n: F.when((ceil_a < floor_b) & keep, F.struct(F.lit(k).alias("level"), n.alias("node")))
        left = node((ceil_a.bitwiseAND(one) == 1) if k < levels - 1 else F.lit(True), ceil_a)
        right = node((floor_b.bitwiseAND(one) == 1) & ~((ceil_a.bitwiseAND(one) == 1) & (ceil_a == floor_b - 1)), floor_b - 1) if k < levels - 1 else F.lit(None).cast("struct<level:int,node:bigint>")
        return F.array(left, right)

    nodes = F.filter(F.flatten(F.array(*[at(k) for k in range(levels)])), lambda x: x.isNotNull())
    return out.withColumn("_n", F.explode(nodes)).select(*versions.columns, F.col("_n.level").alias("level"), F.col("_n.node").alias("node"))


def _levels(origin: int, last: int, leaf_bits: int) -> int:
    """How many levels of nodes span the leaves from origin to last."""
    return (max(1, ((last - origin) >> leaf_bits) + 1) - 1).bit_length() + 1


def _grouped(events: DataFrame, key: list[str], entity: str, at: str, nodes: DataFrame, origin: int, levels: int, leaf_bits: int) -> DataFrame:
    """key and _v of the best version of each event, both sides shuffled on entity and node in SALTS parts.

    Only the key is multiplied by the levels, and matches are combined map-side before they are shuffled.
    """
    salted = nodes.withColumn("_ns", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    leaf = F.shiftright(F.col(at) - origin, leaf_bits)
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(leaf, k).alias("node")) for k in range(levels)])
    probes = events.withColumn("_ks", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).withColumn("_k", F.explode(keys)).withColumn("_kl", F.col("_k.level")).withColumn("_kn", F.col("_k.node")).drop("_k")
    hit = (F.col(entity) == F.col("_e")) & (F.col("_kl") == F.col("level")) & (F.col("_kn") == F.col("node")) & (F.col("_ks") == F.col("_ns")) & (F.col(at) >= F.col("_low")) & (F.col(at) < F.col("_high"))
    return probes.join(salted, hit).groupBy(*key).agg(F.max("_v").alias("_v"))


def disjoint(side: DataFrame, leaf_bits: int) -> DataFrame:
    """Versions (_e, _low, _high, _v) without overlaps: at every time the one with the greatest _v holds.

    Where no two overlap they are as they came. Else every bound is matched, like an event, with the versions valid there,
    and the winner holds up to the next bound of its entity.
    """
    side = cut(side.where("_e is not null and _low < _high"))
    chunked = lambda df, by: df.withColumn("_chunk", F.shiftright(by, 42))  # noqa: E731  about 50 days
    pairs = with_neighbours(chunked(side, "_low"), ["_e"], "_chunk", ["_low", "_high"], F.struct("_high"), before="_before")
    if pairs.where("_before._high > _low").isEmpty():
        return side
    bounds = side.select("_e", F.explode(F.array("_low", "_high")).alias("_t")).distinct()
    span = bounds.agg(F.min("_t").alias("a"), F.max("_t").alias("b")).first()
    levels = _levels(span.a, span.b, leaf_bits)
    nodes = dyadic_nodes(side, F.col("_low"), F.col("_high"), span.a, leaf_bits, levels)
    points = bounds.select(F.col("_e").alias("_pe"), F.col("_t").alias("_pt"))
    won = _grouped(points, ["_pe", "_pt"], "_pe", "_pt", nodes, span.a, levels, leaf_bits)
    ends = with_neighbours(chunked(bounds, "_t"), ["_e"], "_chunk", ["_t"], F.struct("_t"), after="_next")
    parts = ends.join(won, (F.col("_e") == F.col("_pe")) & (F.col("_t") == F.col("_pt")))
    return cut(parts.select("_e", F.col("_t").alias("_low"), F.col("_next._t").alias("_high"), "_v").where("_high is not null"))


def attach_as_of(events: DataFrame, versions: DataFrame, entity: str, at: str, low: str, high: str, carry: list[str], precedence: list[str], event_key: list[str], leaf_bits: int = LEAF_BITS, probe: DataFrame | None = None, tiled: bool = False) -> DataFrame:
    """events, every row as it is, with struct `version` of the carried columns of the version valid at its time, or null.

    at, low, high: microseconds (bigint); valid means low <= at < high. entity: column of both sides. Among overlapping
    versions the one with the greatest `precedence` columns wins (nulls lowest, then the carried values), whatever the
    order of rows. Null entity or time: version null. A version with null entity or bound matches nothing. Extra columns
    of either side do not clash: events keep theirs, of versions only `carry` is taken, inside the struct.

    Nodes that fit are broadcast level by level: versions being disjoint, an event meets at most one, so events are
    neither multiplied nor shuffled. Beyond, the columns that identify events are matched by shuffle and joined back;
    event_key: columns that spread a hot entity (together with entity and time they need not be unique; nulls in them are
    equal); probe: a cheaper table with the same event_key, entity and at as events, to match from. tiled: the versions of
    an entity are known not to overlap, so this is not looked for.
    """
    key = [*dict.fromkeys([*event_key, entity, at])]
    slim = (events if probe is None else probe).select(*key).where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    span = slim.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if span.a is None:
        none = versions.select(F.struct(*carry).alias("version")).schema["version"].dataType
        return events.withColumn("version", F.lit(None).cast(none))
    side = versions.select(F.col(entity).alias("_e"), F.col(low).alias("_low"), F.col(high).alias("_high"), F.struct(*[F.col(c).alias(f"p{k}") for k, c in enumerate(precedence)], F.struct(*carry).alias("v")).alias("_v"))
    levels = _levels(span.a, span.b, leaf_bits)
    whole = side.where("_e is not null and _low < _high") if tiled else disjoint(side, leaf_bits)
    nodes = cut(dyadic_nodes(whole, F.col("_low"), F.col("_high"), span.a, leaf_bits, levels))
    held = {r.level: r.n for r in nodes.groupBy("level").agg(F.sum(row_bytes(nodes.schema)).alias("n")).collect()}  # one row per level
    if sum(held.values()) > BROADCAST_NODES:
        found = _grouped(slim, key, entity, at, nodes, span.a, levels, leaf_bits)
        met = found.select(*[F.col(c).alias(f"_m{k}") for k, c in enumerate(key)], F.col("_v.v").alias("version"))
        same = F.lit(True)
        for k, c in enumerate(key):
            same &= (F.col(c) == F.col(f"_m{k}")) if c in (entity, at) else F.col(c).eqNullSafe(F.col(f"_m{k}"))
        return events.join(met, same, "left").select(*events.columns, "version")
    out, leaf, some = events, F.shiftright(F.col(at) - span.a, leaf_bits), []
    for k in sorted(held):
        level = nodes.where(F.col("level") == k).select(F.col("_e").alias(f"_e{k}"), F.col("node").alias(f"_n{k}"), F.col("_low").alias(f"_l{k}"), F.col("_high").alias(f"_h{k}"), F.col("_v.v").alias(f"_v{k}"))
        hit = (F.col(entity) == F.col(f"_e{k}")) & (F.shiftright(leaf, k) == F.col(f"_n{k}")) & (F.col(at) >= F.col(f"_l{k}")) & (F.col(at) < F.col(f"_h{k}"))
        out = out.join(F.broadcast(level), hit, "left")
        some.append(f"_v{k}")
    none = nodes.schema["_v"].dataType["v"].dataType
    return out.select(*events.columns, F.coalesce(*some, F.lit(None).cast(none)).alias("version"))
