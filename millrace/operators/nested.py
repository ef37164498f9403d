"""Deeply nested JSON bodies to flat line rows, by vectorised structural indexing.

A slice of bodies is one byte buffer. Bitmaps of quotes (less the escaped ones), brackets and delimiters, a prefix sum
over quotes (inside a string?) and one over brackets (depth) give the tokens; tokens sorted by depth give each its
container. From these arrays bodies are checked against the JSON grammar, members and elements are addressed and spans
cut out, without a parser walking the text. Strings that hold JSON text are decoded and indexed in a further round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.session import spread

#: Bytes indexed at once; a longer body is indexed alone.
SLICE_BYTES = 1 << 21
LINES = pa.schema([("raw_id", pa.int64()), ("transaction_id", pa.string()), ("line_pos", pa.int32()), ("product_id", pa.string()), ("quantity", pa.string()), ("unit_price", pa.string())])
LINES_SCHEMA = "raw_id bigint, transaction_id string, line_pos int, product_id string, quantity string, unit_price string"
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_OPEN, _CLOSE, _STRING, _SCALAR_KIND, _COLON, _COMMA = 1, 2, 3, 4, 5, 6
NAMES = ["payload", "transaction_id", "line_items", "product_id", "quantity", "unit_price"]
PAYLOAD, TRANSACTION, ITEMS, PRODUCT, QUANTITY, PRICE = range(6)
# Roles of a text: what its value stands for.
BODY, PAYLOAD_PART, LINES_PART, LINE_PART = range(4)


class Index:
    """Tokens of some texts: pos, end (exclusive), kind, doc, byte; of those that are values: parent, name, rank; ok by doc."""

    def __init__(self, texts: list[bytes]):
        self.data = data = b"\n".join(texts)
        b = np.frombuffer(data, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.int64)
        n_docs = len(texts)
        ok = np.ones(n_docs, bool)
        doc_of = lambda p: np.searchsorted(starts, p, "right") - 1

        # Quote bitmap: a quote after an odd run of backslashes is none.
        quote = b == 34
        slashes = np.flatnonzero(b == 92)
        escaped = np.empty(0, np.int64)
        if len(slashes):
            new = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
            ends = slashes[new] + np.diff(new, append=len(slashes))
            escaped = ends[(ends - slashes[new]) % 2 == 1]
            escaped = escaped[escaped < len(b)]
            quote[escaped] = False
            what = b[escaped]
            bad = ~np.isin(what, np.frombuffer(b'"\\/bfnrtu', np.uint8))
            ok[doc_of(escaped[bad])] = False
            u = escaped[what == 117]
            if len(u):
                hexa = np.zeros(256, bool)
                hexa[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = True
                four = np.minimum(u[:, None] + np.arange(1, 5), len(b) - 1)
                ok[doc_of(u[~hexa[b[four]].all(1)])] = False
        # Inside a string: parity of the prefix sum over quotes, counted from the start of each text.
        total = np.cumsum(quote, dtype=np.int32)
        before = np.where(starts > 0, total[np.minimum(starts, len(b)) - 1], 0) if len(b) else np.zeros(n_docs, np.int32)
        span = lengths + 1
        if n_docs:
            span[-1] -= 1
        inside = ((total - np.repeat(before, span).astype(np.int32)) & 1).astype(bool)
        ok[doc_of(np.flatnonzero(inside & (b < 32)))] = False  # also a text that ends inside a string: its newline
        if n_docs and lengths[-1] and inside[-1]:
            ok[-1] = False
        outside = ~inside & ~quote
        blank = (b == 32) | (b == 9) | (b == 10) | (b == 13)
        kind_of = np.zeros(256, np.uint8)
        for chars, k in ((b"{[", _OPEN), (b"}]", _CLOSE), (b":", _COLON), (b",", _COMMA)):
            kind_of[np.frombuffer(chars, np.uint8)] = k
        kind_at = np.where(outside, kind_of[b], 0)
        kind_at[quote & inside] = _STRING
        plain = outside & (kind_at == 0) & ~blank
        fresh = plain.copy()
        fresh[1:] &= ~plain[:-1]
        kind_at[fresh] = _SCALAR_KIND

        pos = np.flatnonzero(kind_at)
        kind = kind_at[pos]
        doc = doc_of(pos)
        end = pos + 1
        quotes = np.flatnonzero(quote)
        strings = kind == _STRING
        nxt = np.searchsorted(quotes, pos[strings], "right")
        end[strings] = np.where(nxt < len(quotes), quotes[np.minimum(nxt, len(quotes) - 1)] + 1, len(b)) if len(quotes) else 0
        scalars = np.flatnonzero(kind == _SCALAR_KIND)
        stops = np.flatnonzero(plain & ~np.append(plain[1:], False)) + 1
        end[scalars] = stops
        if len(scalars):
            good_scalar = pc.match_substring_regex(spans(b, pos[scalars], end[scalars]), _SCALAR).to_numpy(zero_copy_only=False)
            ok[doc[scalars[~good_scalar]]] = False

        # Depth: prefix sum over brackets, from the start of each text.
        step = np.where(kind == _OPEN, 1, np.where(kind == _CLOSE, -1, 0))
        run = np.cumsum(step)
        first = np.searchsorted(doc, np.arange(n_docs))
        if not len(pos):  # nothing but blanks
            none = np.empty(0, np.int64)
            self.pos = self.end = self.kind = self.doc = self.byte = self.parent = self.name = self.values = self.rank = self.closing = none
            self.ok = np.zeros(n_docs, bool)
            return
        base = np.where(first > 0, run[np.minimum(first, len(run) - 1) - 1], 0)
        after = run - base[doc]
        ok[doc[after < 0]] = False
        last = np.searchsorted(doc, np.arange(n_docs), "right") - 1
        some = last >= first
        ok[~some] = False
        ok[some & (after[np.maximum(last, 0)] != 0)] = False
        # A token's level is the number of containers around it; a bracket heads (or ends) the level inside it.
        level = after - (kind == _OPEN)
        inner = np.where((kind == _OPEN) | (kind == _CLOSE), level + 1, level)
        by_level = np.lexsort((np.arange(len(pos)), inner, doc))
        head = np.where(kind[by_level] == _OPEN, np.arange(len(pos)), -1)
        group = np.flatnonzero((np.diff(doc[by_level], prepend=-1) != 0) | (np.diff(inner[by_level], prepend=-1) != 0))
        floor = np.zeros(len(pos), np.int64)
        floor[group] = group
        floor = np.maximum.accumulate(floor)
        seen = np.maximum.accumulate(head)
        holder = np.full(len(pos), -1)
        holder[by_level] = np.where(seen >= floor, by_level[np.maximum(seen, 0)], -1)
        # holder of an open bracket is itself; its own container is that of the level outside.
        parent = holder.copy()
        brackets = np.flatnonzero((kind == _OPEN) | (kind == _CLOSE))
        outer = np.full(len(pos), -1)
        by_outer = np.lexsort((np.arange(len(pos)) * 2 + 1, level, doc))  # members of a level, to be merged with its heads
        heads = np.flatnonzero(kind == _OPEN)
        both = np.concatenate([by_outer, heads])
        lev = np.concatenate([level[by_outer], level[heads] + 1])
        at = np.concatenate([by_outer, heads])
        is_head = np.concatenate([np.zeros(len(by_outer), bool), np.ones(len(heads), bool)])
        o = np.lexsort((is_head, at, lev, doc[both]))
        k = np.where(is_head[o], np.arange(len(o)), -1)
        g = np.flatnonzero((np.diff(doc[both[o]], prepend=-1) != 0) | (np.diff(lev[o], prepend=-1) != 0))
        fl = np.zeros(len(o), np.int64)
        fl[g] = g
        fl = np.maximum.accumulate(fl)
        k = np.maximum.accumulate(k)
        found = np.where(k >= fl, at[o][np.maximum(k, 0)], -1)
        outer[both[o][~is_head[o]]] = found[~is_head[o]]
        parent[brackets] = outer[brackets]
        byte = b[pos]
        # Brackets must pair with their like: the opener that a closer ends is its holder.
        closers = np.flatnonzero(kind == _CLOSE)
        opener = holder[closers]
        closing = np.full(len(pos), -1)
        closing[opener[opener >= 0]] = closers[opener >= 0]
        ok[doc[closers[(opener < 0) | (byte[np.maximum(opener, 0)] + 2 != byte[closers])]]] = False

        # Grammar, by pairs of neighbours. in_obj: the container is an object; key: a string that opens a member.
        prev = np.arange(len(pos)) - 1
        start = np.zeros(len(pos), bool)
        start[first[some]] = True
        pk = np.where(start, 0, kind[prev])
        in_obj = (parent >= 0) & (byte[np.maximum(parent, 0)] == 123)
        root = parent < 0
        head_before = ~start & (pk == _OPEN)
        comma_before = pk == _COMMA
        key = strings & in_obj & (head_before | comma_before)
        value = ((kind == _STRING) | (kind == _SCALAR_KIND) | (kind == _OPEN)) & ~key
        p_key = np.where(start, False, key[prev])
        p_end = ((pk == _STRING) | (pk == _SCALAR_KIND) | (pk == _CLOSE)) & ~p_key
        good = np.zeros(len(pos), bool)
        good |= key
        good |= value & in_obj & (pk == _COLON)
        good |= value & ~in_obj & ~root & (head_before | comma_before)
        good |= value & root & (start | ((kind == _OPEN) & (pk == _CLOSE)))  # several bodies in a row are objects or arrays
        good |= (kind == _COLON) & p_key
        good |= (kind == _COMMA) & ~root & p_end
        good |= (kind == _CLOSE) & (p_end | head_before)
        ok[doc[~good]] = False

        self.pos, self.end, self.kind, self.doc, self.byte, self.parent, self.ok, self.closing, self.bytes, self.escaped = pos, end, kind, doc, byte, parent, ok, closing, b, escaped
        self.name = np.full(len(pos), -1, np.int8)
        members = np.flatnonzero(value & in_obj & ok[doc])
        keys = members - 2
        size = end[keys] - pos[keys] - 2
        for n, word in enumerate(NAMES):
            fit = np.flatnonzero(size == len(word))
            if len(fit):
                same = (b[pos[keys[fit]][:, None] + 1 + np.arange(len(word))] == np.frombuffer(word.encode(), np.uint8)).all(1)
                self.name[members[fit[same]]] = n
        if len(escaped):
            hit = np.searchsorted(escaped, end[keys]) > np.searchsorted(escaped, pos[keys])
            for m in members[hit]:
                word = json.loads(self.text(m - 2))
                self.name[m] = NAMES.index(word) if word in NAMES else -1
        self.values = np.flatnonzero(value & ok[doc])
        order = np.lexsort((self.values, parent[self.values], doc[self.values]))
        v = self.values[order]
        fresh_group = (np.diff(parent[v], prepend=-2) != 0) | (np.diff(doc[v], prepend=-1) != 0)
        at0 = np.maximum.accumulate(np.where(fresh_group, np.arange(len(v)), 0)) if len(v) else np.empty(0, np.int64)
        self.rank = np.zeros(len(pos), np.int64)
        self.rank[v] = np.arange(len(v)) - at0 + 1

    def text(self, token: int) -> bytes:
        return self.data[self.pos[token] : self.end[token]]

    def decoded(self, tokens: np.ndarray) -> pa.Array:
        """Strings as what they say, null as null, anything else (objects and arrays too) as it is written. Token -1: null."""
        if not len(tokens) or not len(self.pos):
            return pa.nulls(len(tokens), pa.large_string())
        t = np.maximum(tokens, 0)
        string, opened = self.kind[t] == _STRING, self.kind[t] == _OPEN
        first, last = self.pos[t] + string, np.where(opened, self.end[np.maximum(self.closing[t], 0)], self.end[t] - string)
        none = (tokens < 0) | (~string & ~opened & (last - first == 4) & (self.bytes[np.minimum(first, len(self.bytes) - 1)] == 110))
        out = spans(self.bytes, first, np.where(none, first, last), none)
        hard = np.flatnonzero(string & ~none & (np.searchsorted(self.escaped, last) > np.searchsorted(self.escaped, first))) if len(self.escaped) else ()
        if len(hard):  # strings with escapes, the few there are
            said = [json.loads(self.text(x)).encode("utf-8", "replace").decode() for x in t[hard]]
            mask = np.zeros(len(tokens), bool)
            mask[hard] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array(said, pa.large_string()))
        return out


def spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """data[first:last] of each pair as texts, gathered at once; null where none."""
    size = last - first
    offset = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    held = data[np.repeat(first - offset[:-1], size) + np.arange(offset[-1])]
    valid = None if none is None else pa.array(~none).buffers()[1]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offset), pa.py_buffer(np.ascontiguousarray(held)), valid)


def _json_like(text: str) -> bool:
    return text.lstrip(" \t\r\n")[:1] in ("{", "[", '"')


def extract_lines(bodies: list[tuple[int, str]]) -> pa.Table:
    """Line rows (LINES_SCHEMA) of some bodies; nothing for a body that is not JSON. Rows of one body do not repeat."""
    found = [LINES.empty_table()]
    # What is still to be indexed: raw_id, role, transaction_id, line position, text.
    todo = [(raw, BODY, None, 0, text) for raw, text in bodies]
    while todo:
        ix = Index([x[4].encode("utf-8", "surrogatepass") for x in todo])
        more: list[tuple] = []
        role = np.fromiter((x[1] for x in todo), np.int8, len(todo))
        v, parent, name = ix.values, ix.parent, ix.name
        obj, arr, text = (lambda t: ix.byte[t] == 123), (lambda t: ix.byte[t] == 91), (lambda t: ix.kind[t] == _STRING)  # noqa: E731, B023

        def again(tokens: np.ndarray, role: int, transactions: np.ndarray | None = None, at: np.ndarray | None = None) -> None:
            """Texts that may hold JSON, for the next round; transactions: tokens (-1: that of the text's own round)."""
            tokens = np.asarray(tokens, np.int64)
            if not len(tokens):
                return
            said = ix.decoded(transactions).to_pylist() if transactions is not None else [None] * len(tokens)  # noqa: B023
            for k, inner in enumerate(ix.decoded(tokens).to_pylist()):  # noqa: B023
                if inner is not None and _json_like(inner):
                    _, _, before, place, _ = todo[ix.doc[tokens[k]]]  # noqa: B023
                    more.append((todo[ix.doc[tokens[k]]][0], role, said[k] if transactions is not None and transactions[k] >= 0 else before, place if at is None else int(at[k]), inner))  # noqa: B023

        def members(holders: np.ndarray, which: int) -> np.ndarray:
            """The last member of that name of each of the objects."""
            mark = np.zeros(len(ix.pos) + 1, bool)  # noqa: B023
            mark[holders] = True
            mark[-1] = False  # parent -1: none
            m = v[(name[v] == which) & mark[parent[v]]]  # noqa: B023
            m = m[np.lexsort((m, parent[m]))]  # noqa: B023
            return m[np.append(np.diff(parent[m]) != 0, True)] if len(m) else m  # noqa: B023

        def member_of(holders: np.ndarray, which: int) -> np.ndarray:
            """That member of each of the objects, -1 for none."""
            out = np.full(len(ix.pos) + 1, -1)  # noqa: B023
            m = members(holders, which)
            out[parent[m]] = m  # noqa: B023
            return out[holders]

        def elements(lists: np.ndarray) -> np.ndarray:
            mark = np.zeros(len(ix.pos) + 1, bool)  # noqa: B023
            mark[lists] = True
            mark[-1] = False
            return v[(parent[v] >= 0) & mark[parent[v]]]  # noqa: B023

        roots = v[parent[v] < 0]
        r = role[ix.doc[roots]] if len(roots) else np.empty(0, np.int8)
        # Bodies: objects are envelopes; arrays of them, to any depth.
        envelopes, level = [np.empty(0, np.int64)], roots[r == BODY]
        while len(level):
            envelopes.append(level[obj(level)])
            again(level[text(level)], BODY)
            level = elements(level[arr(level)])
        parts = members(np.concatenate(envelopes), PAYLOAD)
        own = roots[r == PAYLOAD_PART]
        again(np.concatenate([parts[text(parts)], own[text(own)]]), PAYLOAD_PART)
        payloads = np.concatenate([parts[obj(parts)], own[obj(own)]])
        # The line items: an array, one object, or a text that holds either; transactions by token, -1 for that of the round before.
        said = np.full(len(ix.pos) + 1, -1)
        said[payloads] = member_of(payloads, TRANSACTION)
        lists = members(payloads, ITEMS)
        outer = roots[r == LINES_PART]
        holder = np.concatenate([said[parent[lists]], np.full(len(outer), -1)])
        lists = np.concatenate([lists, outer])
        again(lists[text(lists)], LINES_PART, holder[text(lists)])
        of_list = np.full(len(ix.pos) + 1, -1)
        of_list[lists] = holder
        each = elements(lists[arr(lists)])
        again(each[text(each)], LINE_PART, of_list[parent[each[text(each)]]], ix.rank[each[text(each)]])
        lone = roots[r == LINE_PART]
        again(lone[text(lone)], LINE_PART)
        own_place = lambda t: np.fromiter((todo[d][3] for d in ix.doc[t]), np.int64, len(t))  # noqa: B023, E731
        items = np.concatenate([lists[obj(lists)], each[obj(each)], lone[obj(lone)]])
        if len(items):
            places = np.concatenate([np.ones(obj(lists).sum(), np.int64), ix.rank[each[obj(each)]], own_place(lone[obj(lone)])])
            token = np.concatenate([holder[obj(lists)], of_list[parent[each[obj(each)]]], np.full(obj(lone).sum(), -1)])
            before = pa.array([x[2] for x in todo], pa.large_string()).take(pa.array(ix.doc[items]))
            transaction = pc.if_else(pa.array(token >= 0), ix.decoded(token), before)
            fields = [ix.decoded(member_of(items, which)) for which in (PRODUCT, QUANTITY, PRICE)]
            raw = np.fromiter((x[0] for x in todo), np.int64, len(todo))[ix.doc[items]]
            rows = pa.table([pa.array(raw), transaction, pa.array(places, pa.int32()), *fields], names=LINES.names)
            whole = pc.and_(pc.and_(fields[0].is_valid(), fields[1].is_valid()), fields[2].is_valid())
            found.append(rows.filter(whole).cast(LINES))
        todo = more
    return pa.concat_tables(found).group_by(LINES.names).aggregate([])


def flat_lines(bodies: DataFrame) -> DataFrame:
    """Line rows (LINES_SCHEMA) of raw_id, event_json: the flat child table, linked by raw_id and transaction_id.

    A line is an object in payload.line_items of any envelope of a body, with product_id, quantity and unit_price present
    and not null; other lines give no row but keep their position. quantity and unit_price come as text as written.
    Null, empty or broken bodies (not JSON by RFC 8259) give none. line_items that is one object is a list of one.
    Bodies, payloads, line_items and lines that are JSON text count as what they hold; text that is not JSON counts as no
    lines. A member given twice counts as last given. A missing or null transaction_id is null. No shuffle but for inputs of fewer partitions than cores.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for raw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                if part and size + len(text) > SLICE_BYTES:
                    yield from extract_lines(part).to_batches()
                    part, size = [], 0
                part.append((raw, text))
                size += len(text)
            if part:
                yield from extract_lines(part).to_batches()

    return spread(bodies.select("raw_id", "event_json"), "raw_id").mapInArrow(rows, LINES_SCHEMA)
