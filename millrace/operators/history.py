"""History of changing attributes: a bitemporal ledger.

Each ledger row says that an entity had these attributes during [valid_from, valid_to), as recorded from recorded_at
until superseded_at (null: still believed). A batch of updates is swept together with the believed rows of its entities
in order of valid time: an update that falls inside a believed interval splits it. The shortened row is added and the
former one is only closed (superseded_at), never changed otherwise. The believed rows of any recorded time tile valid time.

Believed rows are kept in buckets of entities (operators/parts.py), of which a batch reads and rewrites those it touches;
closed rows are appended, a folder per batch. A sweep takes one range exchange (operators/sweep.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from millrace.operators.parts import Parts
from millrace.operators.sweep import changes, edges, sorted_rows, sweep
from millrace.sources.landing import Files

OPEN = -1
#: Buckets of entities in which believed rows are kept; to be raised with the number of entities.
BUCKETS = 16
ATTRS = "struct<a: string, b: string>"
ORDER = ["source_table", "entity_id", "valid_from", "seq"]


def normal(text: Column) -> Column:
    """Text without surrounding blanks and in one case; null stays null (and a blank text stays a value)."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def _keyed(df: DataFrame) -> DataFrame:
    """df with the entity as one text."""
    return df.withColumn("_k", F.to_json(F.struct("source_table", "entity_id")))


def _following(firsts: dict[int, tuple]) -> dict[int, tuple]:
    """Of each partition number the row of the next partition that has any."""
    out, after = {}, None
    for part in range(max(firsts, default=-1), -1, -1):
        if after is not None:
            out[part] = after
        after = firsts.get(part, after)
    return out


def _preceding(lasts: dict[int, tuple], partitions: int) -> dict[int, tuple]:
    out, before = {}, None
    for part in range(partitions):
        if before is not None:
            out[part] = before
        before = lasts.get(part, before)
    return out


def tiled(points: DataFrame) -> DataFrame:
    """points (ORDER, fresh, others) with valid_to: the next valid_from of the entity, OPEN for its last.

    Of points with equal ORDER one stays, rather one that is not fresh. Points at one instant give intervals of length 0.
    """
    rows = sorted_rows(_keyed(points), ORDER, ["fresh"])
    after = _following(edges(rows, ["_k", "valid_from"], last=False))
    kept = [f.name for f in rows.schema.fields if f.name != "_k"]

    def each(table: pa.Table, state: dict, ended: bool) -> pa.Table | None:
        table = pa.concat_tables([state.pop("held"), table]) if "held" in state else table
        if table.num_rows == 0:
            return None
        first = changes(table["_k"])
        table = table.filter(pa.array(first | changes(table["valid_from"]) | changes(table["seq"])))
        keys, starts = table["_k"], table["valid_from"].to_numpy()
        follows = ~np.append(changes(keys)[1:], True)  # whether the next row is the same entity's
        to = np.where(follows, np.append(starts[1:], 0), OPEN)
        if ended:
            if "next" in state and state["next"][0] == keys[-1].as_py():
                to[-1] = state["next"][1]
        else:
            state["held"] = table.slice(table.num_rows - 1)
            table, to = table.slice(0, table.num_rows - 1), to[:-1]
        return table.select(kept).append_column("valid_to", pa.array(to, pa.int64()))

    schema = StructType([f for f in rows.schema.fields if f.name != "_k"]).add("valid_to", LongType())
    return sweep(rows, schema, each, {p: {"next": r} for p, r in after.items()})


class Ledger:
    """open/: believed rows in buckets; closed/batch=B: the rows that batch B superseded. Batches are numbered upwards."""

    def __init__(self, spark: SparkSession, root: str, attrs: str = ATTRS, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.parts, self._files = Parts(spark, f"{self.root}/open", "bucket"), Files(spark, root)
        self._open = f"source_table string, entity_id string, valid_from bigint, seq bigint, attrs {attrs}, valid_to bigint, recorded_at bigint"
        self._all = f"{self._open}, superseded_at bigint"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_table", "entity_id"), F.lit(self.buckets)).cast("int")

    def apply(self, number: int, updates: DataFrame, recorded_at: int) -> list[int]:
        """Take a batch; the buckets it touched. A batch that was taken already changes nothing.

        updates: source_table, entity_id, valid_from (microseconds), seq (unique; breaks ties of valid_from), attrs; written
        or cached, as it is read more than once. Rows with null entity or time are left out. An update that is in the
        ledger already (same source_table, entity_id, valid_from, seq) changes nothing.
        """
        if number <= self.parts.applied:
            return []
        new = updates.where("entity_id is not null and valid_from is not null").select(*ORDER, "attrs")
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())  # one row per bucket
        none = F.lit(None).cast("bigint")
        points = new.select("*", none.alias("was_to"), none.alias("was_recorded"))
        held = self.parts.read(self._open, touched).select(*ORDER, "attrs", F.col("valid_to").alias("was_to"), F.col("recorded_at").alias("was_recorded"))
        swept = tiled(points.unionByName(held).withColumn("fresh", F.col("was_recorded").isNull()))
        # A point gives its row as it stands, or (if split) the closed former row and the shortened one.
        row = lambda to, recorded, superseded: F.struct(to.alias("valid_to"), recorded.alias("recorded_at"), superseded.alias("superseded_at"))
        now = F.lit(recorded_at).cast("bigint")
        split = ~F.col("fresh") & (F.col("was_to") != F.col("valid_to"))
        rows = F.when(split, F.array(row(F.col("was_to"), F.col("was_recorded"), now), row(F.col("valid_to"), now, none))).otherwise(F.array(row(F.col("valid_to"), F.coalesce("was_recorded", now), none)))
        out = swept.select(*ORDER, "attrs", F.explode(rows).alias("r")).select(*ORDER, "attrs", "r.*")
        self.parts.write(number, out.where("superseded_at is null").drop("superseded_at").withColumn("bucket", self._bucket()).hint("rebalance", "bucket"))
        out.where("superseded_at is not null").write.mode("overwrite").parquet(f"{self.root}/closed/batch={number}")
        self.parts.publish(number, touched, recorded_at)
        return touched

    def rows(self) -> DataFrame:
        """All rows, superseded ones included."""
        done = [f"{self.root}/closed/{n}" for n, _, _ in self._files.children(f"{self.root}/closed") if int(n.split("=")[1]) <= self.parts.applied]
        now = self.believed().withColumn("superseded_at", F.lit(None).cast("bigint"))
        return now.unionByName(self.spark.read.schema(self._all).parquet(*done)) if done else now

    def believed(self, at: int | None = None) -> DataFrame:
        """The rows believed at that recorded time (None: now)."""
        if at is None:
            return self.parts.read(self._open)
        return self.rows().where((F.col("recorded_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at)))


def versions(rows: DataFrame) -> DataFrame:
    """Believed rows with equal neighbours merged: source_table, entity_id, version_no, valid_from, valid_to (-1: open), attrs.

    attrs are compared as they stand, null being a value of its own. rows should be written.
    """
    s = sorted_rows(_keyed(rows.select(*ORDER, "attrs")).withColumn("_a", F.to_json("attrs")), ORDER)
    before = _preceding(edges(s, ["_k", "_a"], last=True), s.rdd.getNumPartitions())

    def mark(table: pa.Table, state: dict, ended: bool) -> pa.Table | None:
        if ended:
            return None
        keys, attrs = table["_k"], table["_a"]
        start = changes(keys) | changes(attrs)
        start[0] = state.get("prev") != (keys[0].as_py(), attrs[0].as_py())
        state["prev"] = (keys[-1].as_py(), attrs[-1].as_py())
        return table.select(["_k", "source_table", "entity_id", "valid_from", "attrs"]).filter(pa.array(start))

    kinds = StructType([s.schema[c] for c in ("_k", "source_table", "entity_id", "valid_from", "attrs")])
    starts = sweep(s, kinds, mark, {p: {"prev": r} for p, r in before.items()})
    firsts = edges(starts, ["_k", "valid_from"], last=False)
    after = _following(firsts)

    def number(table: pa.Table, state: dict) -> np.ndarray:
        """Version numbers of starts, going on with those of the rows before."""
        first = changes(table["_k"])
        first[0] = state.get("key") != table["_k"][0].as_py()
        at = np.arange(len(first))
        base = np.maximum.accumulate(np.where(first, at, -1))
        out = np.where(base < 0, state.get("count", 0) + at + 1, at - base + 1)
        state["key"], state["count"] = table["_k"][-1].as_py(), int(out[-1])
        return out

    def last_number(table: pa.Table, state: dict, ended: bool) -> pa.Table | None:
        """How many starts the last entity has in this partition, and whether it is the partition's only one."""
        if not ended:
            state["only"] = state.get("only", True) and not changes(table["_k"])[1:].any() and state.get("key", table["_k"][0].as_py()) == table["_k"][0].as_py()
            number(table, state)
            return None
        if "key" not in state:
            return None
        return pa.table({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "key": [state["key"]], "n": pa.array([state["count"]], pa.int64()), "only": [state["only"]]})

    begin, key, count = {}, None, 0
    found = {r.part: r for r in sweep(starts, "part int, key string, n bigint, only boolean", last_number, {}).collect()}  # one row per partition
    for part in range(s.rdd.getNumPartitions()):
        begin[part] = {"key": key, "count": count, **({"next": after[part]} if part in after else {})}
        if part in found:
            r = found[part]
            count = r.n + (count if r.only and r.key == key else 0)
            key = r.key

    def finish(table: pa.Table, state: dict, ended: bool) -> pa.Table | None:
        if not ended:
            table = table.append_column("version_no", pa.array(number(table, state), pa.int32()))
        if "held" in state:
            table = state.pop("held") if ended else pa.concat_tables([state.pop("held"), table])
        if table.num_rows == 0 or "version_no" not in table.column_names:
            return None
        starts_at = table["valid_from"].to_numpy()
        to = np.where(~np.append(changes(table["_k"])[1:], True), np.append(starts_at[1:], 0), OPEN)
        if ended:
            if "next" in state and state["next"][0] == table["_k"][-1].as_py():
                to[-1] = state["next"][1]
        else:
            state["held"] = table.slice(table.num_rows - 1)
            table, to = table.slice(0, table.num_rows - 1), to[:-1]
        return table.append_column("valid_to", pa.array(to, pa.int64())).select(["source_table", "entity_id", "version_no", "valid_from", "valid_to", "attrs"])

    out = StructType([kinds["source_table"], kinds["entity_id"]]).add("version_no", IntegerType()).add("valid_from", LongType()).add("valid_to", LongType()).add(kinds["attrs"])
    return sweep(starts, out, finish, begin)
