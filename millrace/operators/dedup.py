"""Messages delivered more than once: exact quotient hash tables.

An identifier is packed into a fixed width: four 64-bit words (a UUID in canonical lower case into two), its length, and a
tail only where it is longer than 32 bytes. The words are permuted by a Feistel network, a bijection: the first permuted
word is the quotient (its leading bits name the shard, its last ones the place in a table), all other bits with kind,
length and tail are the complete remainder. Equal quotient and remainder therefore mean equal identifier, so a table never
matches falsely and never keeps the text.

Each task inserts its identifiers once into a table of its own, so of a hot identifier one row per table is shuffled. Rows
go to the task of their shard, in order of quotient (Spark's sort, which spills); there a table after table takes all rows
of a range of quotients and is dropped, so a task's memory is bounded however large its shard. A row that finds its
identifier taken by a smaller order is refused; so is the holder, when a smaller order comes later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Leading bits of the quotient that name its shard.
SHARD_BITS = 12
#: Identifiers that one table takes before it is emptied (before the shuffle) or dropped (after it).
TABLE_ROWS = 1 << 18
WORDS, FIXED = 4, 32
KEY = ["kind", "width", "w0", "w1", "w2", "w3", "tail"]
#: What a row is: a candidate for its identifier, refused, or an identifier of an earlier batch.
CANDIDATE, REFUSED, SEEN = 0, 1, 2
_ROWS = "kind int, width int, w0 bigint, w1 bigint, w2 bigint, w3 bigint, tail binary, ord bigint, state int, shard int"
_SCHEMA = pa.schema([("kind", pa.int32()), ("width", pa.int32()), *((f"w{k}", pa.int64()) for k in range(WORDS)), ("tail", pa.binary()), ("ord", pa.int64()), ("state", pa.int32()), ("shard", pa.int32())])
_UUID_WIDTH = -16  # no text has this length
_DASHES, _HEX = np.array([8, 13, 18, 23]), np.full(256, 16, np.uint8)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
_DIGITS = np.setdiff1d(np.arange(36), _DASHES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pack(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(permuted words, widths, tails or None) of non-null texts: equal exactly where the texts are equal, as they stand."""
    flat = ids.cast(pa.large_binary())
    n, at = len(flat), np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None and at[-1] > at[0] else np.zeros(1, np.uint8)
    size = np.diff(at)
    reach = at[:-1, None] + np.arange(36)
    chars = np.where(np.arange(36) < size[:, None], data[np.minimum(reach, len(data) - 1)], 0).astype(np.uint8)
    uuid = (size == 36) & (chars[:, _DASHES] == 45).all(1) & (_HEX[chars[:, _DIGITS]] < 16).all(1)
    fixed = np.zeros((n, FIXED), np.uint8)
    fixed[~uuid] = chars[~uuid, :FIXED]
    nibbles = _HEX[chars[uuid][:, _DIGITS]]
    fixed[uuid, :16] = nibbles[:, 0::2] * 16 + nibbles[:, 1::2]
    w = fixed.view("<u8").astype(np.uint64)
    width = np.where(uuid, _UUID_WIDTH, size).astype(np.int32)
    # Each round changes one word by a function of the others, so the whole can be undone.
    w[:, 0] ^= _mix(w[:, 1] + _mix(w[:, 2] + _mix(w[:, 3] + width.astype(np.uint64))))
    w[:, 1] ^= _mix(w[:, 0] + np.uint64(1))
    w[:, 0] ^= _mix(w[:, 1] + np.uint64(2))
    long = np.flatnonzero((size > FIXED) & ~uuid)
    if not len(long):
        return w, width, None
    tails = np.full(n, None, object)
    for k in long:
        tails[k] = data[at[k] + FIXED : at[k + 1]].tobytes()
    return w, width, tails


class QuotientTable:
    """Remainders by quotient, open addressing with linear probing; batches are inserted as arrays."""

    def __init__(self, bits: int = 10):
        self.bits, self.size = bits, 0
        self._new(bits)

    def _new(self, bits: int) -> None:
        n = 1 << bits
        self.bits, self.used, self.order = bits, np.zeros(n, bool), np.zeros(n, np.int64)
        self.key, self.tail = np.zeros((n, WORDS + 1), np.uint64), np.full(n, None, object)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, tails, orders) of the identifiers in the table."""
        at = np.flatnonzero(self.used)
        return self.key[at], self.tail[at], self.order[at]

    def insert(self, key: np.ndarray, tail: np.ndarray | None, order: np.ndarray) -> np.ndarray:
        """Insert identifiers (words, and kind and width in a fifth); the orders refused by this.

        Of equal identifiers the smallest order stays. Orders of one identifier differ.
        """
        need = self.size + len(order)
        if need * 2 > len(self.used):
            held = self.entries()
            self._new(max(10, (need * 2 - 1).bit_length()))
            self.size = 0
            self._place(*held)
        return self._place(key, tail, order)

    def _place(self, key: np.ndarray, tail: np.ndarray | None, order: np.ndarray) -> np.ndarray:
        by = np.argsort(order, kind="stable")  # of equal identifiers in the batch the smallest order comes first
        key, order = key[by], order[by]
        tail = None if tail is None else tail[by]
        mask = len(self.used) - 1
        pos = (key[:, 0] & np.uint64(mask)).astype(np.int64)
        left, refused = np.arange(len(order)), []
        while len(left):
            free = ~self.used[pos[left]]
            if free.any():
                some = left[free]
                place, first = np.unique(pos[some], return_index=True)
                won = some[first]
                self.used[place], self.key[place], self.order[place] = True, key[won], order[won]
                if tail is not None:
                    self.tail[place] = tail[won]
                self.size += len(won)
                keep = np.ones(len(order), bool)
                keep[won] = False
                left = left[keep[left]]
            at = pos[left]
            same = (self.key[at] == key[left]).all(1)
            if tail is not None:
                same &= self.tail[at] == tail[left]
            elif same.any():
                same &= self.tail[at] == None  # noqa: E711  elementwise
            if same.any():
                at, mine = at[same], order[left[same]]
                held = self.order[at]
                np.minimum.at(self.order, at, mine)
                refused.append(np.where(mine == self.order[at], held, mine))
                left = left[~same]
            pos[left] = (pos[left] + 1) & mask
        return np.concatenate(refused) if refused else np.empty(0, np.int64)


def _batch(key: np.ndarray, tail: np.ndarray, order: np.ndarray, state: int) -> pa.RecordBatch:
    kind, width = (key[:, WORDS] >> np.uint64(32)).astype(np.int32), key[:, WORDS].astype(np.uint32).view(np.int32)
    shard = (key[:, 0] >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(width), *(pa.array(np.ascontiguousarray(key[:, k]).view(np.int64)) for k in range(WORDS)), pa.array(list(tail), pa.binary()), pa.array(order), pa.array(np.full(len(order), state, np.int32)), pa.array(shard)], schema=_SCHEMA)


def _refusals(order: np.ndarray) -> pa.RecordBatch:
    """Refused orders as rows, spread over the shards."""
    key = np.zeros((len(order), WORDS + 1), np.uint64)
    key[:, 0] = _mix(order.astype(np.uint64))
    return _batch(key, np.full(len(order), None, object), order, REFUSED)


def _with_kind(kind: int | np.ndarray, width: np.ndarray) -> np.ndarray:
    return (np.asarray(kind, np.uint64) << np.uint64(32)) | width.view(np.uint32).astype(np.uint64)


def identifier_rows(df: DataFrame, order: str, ids: list[str]) -> DataFrame:
    """The identifiers of each task once (with the smallest order that carries them), and the orders refused already.

    Columns KEY (kind: position in ids), ord, state, shard.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = QuotientTable()
        for batch in batches:
            orders = batch.column(0)
            for kind in range(len(ids)):
                column = batch.column(kind + 1)
                there = column.is_valid()
                words, width, tails = pack(column.filter(there))
                if not len(width):
                    continue
                refused = table.insert(np.column_stack([words, _with_kind(kind, width)]), tails, orders.filter(there).to_numpy(zero_copy_only=False))
                if len(refused):
                    yield _refusals(refused)
            if table.size >= TABLE_ROWS:
                yield _batch(*table.entries(), CANDIDATE)
                table = QuotientTable()
        if table.size:
            yield _batch(*table.entries(), CANDIDATE)

    return df.select(F.col(order).cast("bigint").alias("ord"), *[F.col(c).cast("string").alias(f"i{k}") for k, c in enumerate(ids)]).mapInArrow(rows, _ROWS)


def insert_once(rows: DataFrame, admitted: bool = False) -> DataFrame:
    """rows of all tasks through the tables of their shards: the refused ones (of SEEN rows none), and on request the
    admitted candidates too. Columns as of identifier_rows."""

    def through(key: list[np.ndarray], tail: list[np.ndarray], order: list[np.ndarray], state: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, t, o, s = np.concatenate(key), np.concatenate(tail), np.concatenate(order), np.concatenate(state)
        table = QuotientTable()
        refused = table.insert(k, t, o)
        if len(refused):
            yield _refusals(refused)
        if admitted:
            k, t, o = table.entries()
            new = o > _BEFORE_ALL
            yield _batch(k[new], t[new], o[new], CANDIDATE)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            state = number("state")
            done = state == REFUSED
            if done.any():
                yield _refusals(number("ord")[done])
            open_ = np.flatnonzero(~done)
            if not len(open_):
                continue
            key = np.column_stack([*(number(f"w{k}").view(np.uint64) for k in range(WORDS)), _with_kind(number("kind"), number("width"))])[open_]
            tails = np.array([*batch.column("tail").to_pylist(), None], object)[:-1][open_]
            parts = [key, tails, number("ord")[open_], state[open_]]
            if size + len(open_) >= TABLE_ROWS:
                # Rows come in order of quotient: those up to the last one's quotient are complete.
                rest = np.flatnonzero(key[:, 0] == key[-1, 0])[0]
                if rest or size:
                    if held[0] and not rest and held[0][-1][-1, 0] == key[0, 0]:
                        rest = 0  # the quotient goes on: wait
                    else:
                        for h, p in zip(held, parts):
                            h.append(p[:rest])
                        yield from through(*held)
                        held, size, parts = ([], [], [], []), 0, [p[rest:] for p in parts]
            for h, p in zip(held, parts):
                h.append(p)
            size += len(parts[0])
        if size:
            yield from through(*held)

    return rows.repartition("shard").sortWithinPartitions("w0").mapInArrow(tables, _ROWS)


_BEFORE_ALL = -(1 << 63)


def surplus(df: DataFrame, order: str, ids: list[str]) -> DataFrame:
    """The order values of rows which are not the first (smallest order) carrier of one of their identifiers.

    order: unique integers, not null. A null identifier equals nothing; a row with no identifier is always kept; an empty
    identifier is an identifier. No group of copies is ever collected.
    """
    refused = insert_once(identifier_rows(df, order, ids)).where(F.col("state") == REFUSED)
    return refused.select(F.col("ord").alias(order)).distinct()


def keep_first(df: DataFrame, order: str, ids: list[str]) -> DataFrame:
    """df without its surplus copies; columns as they are. See surplus for nulls and ties."""
    return df.join(surplus(df, order, ids), order, "left_anti")


def admit(batch: DataFrame, seen: DataFrame | None, order: str, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """For deliveries in batches: the rows of batch that carry no identifier seen before, and the keys seen so far.

    seen: what the preceding call returned (KEY), or None. Rows of earlier batches always win; within the batch the
    smallest order wins. An identifier of a refused row counts as seen.
    """
    rows = identifier_rows(batch, order, ids)
    if seen is not None:
        first = F.shiftrightunsigned("w0", 64 - SHARD_BITS).cast("int")
        rows = rows.unionByName(seen.select(*KEY, F.lit(_BEFORE_ALL).cast("bigint").alias("ord"), F.lit(SEEN).alias("state"), first.alias("shard")))
    out = insert_once(rows, admitted=True)
    bad = out.where(F.col("state") == REFUSED).select(F.col("ord").alias(order)).distinct()
    now = out.where(F.col("state") == CANDIDATE).select(*KEY)
    return batch.join(bad, order, "left_anti"), now if seen is None else seen.select(*KEY).unionByName(now)
