"""Encoding a corpus with a byte-level BPE, by a bounded-lookahead streaming transducer.

For a merge list, the encoding of any prefix ends in exactly one token: the one that is compatible with the token before
it (compatible: the two alone encode to themselves). So a left-to-right scan keeps, of each position, the last token of
the encoding of the prefix. A token is stable once the prefixes at all positions that a token can still cross (as many
bytes as the longest token of the merge list has: the lookahead) agree on it; it is emitted and its state dropped.
Decoding is an incremental byte-to-text state machine.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.session import spread

TOKENIZER = "byte_bpe_50k.json"
#: Splits a text before the merges (fixed value of the tokenizer).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters after a match that can still change it ('re needs two more, a following blank or letter one).
HOLD = 3
#: Characters taken at once from a text, and length up to which a piece's ids are remembered, and number of those.
TEXT_SLICE, MEMO_CHARS, MEMO_SIZE = 1 << 16, 40, 400_000


def default_path() -> str:
    """The vocabulary file of the installed public tokenizers; every operator takes another path as parameter."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}


class MergeList:
    """A vocabulary with its merges, and the lookahead that suffices for it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        self.ids = {raw(w): i for w, i in model["vocab"].items() if all(c in letters for c in w)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (raw(w) for w in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[self.ids[a], self.ids[b]] = k, self.ids[a + b]
        #: Longest token in bytes: no token can reach further back than this from what is still to come.
        self.lookahead = max(map(len, self.ids))
        self._fits: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}
        self.words = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.words.add_word(b.decode("latin-1"), (i, len(b)))
        self.words.make_automaton()

    def merged(self, word: bytes) -> list[int]:
        """The encoding by the definition: merge the lowest-ranked neighbours, leftmost first. For words of a token or two."""
        ids = [self.ids[word[k : k + 1]] for k in range(len(word))]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])), key=lambda x: x[0])
            if best[0] == 1 << 60:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.rank.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def own(self, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.merged(self.bytes[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens in a row encode to themselves."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known


class Transducer:
    """Encodes one piece, fed in parts; tokens come out as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.tail = ""  # the bytes that a further token can still cover
        self.last: list[int] = []  # last token of each prefix since the last stable cut
        self.back: list[int] = []  # its length
        self.anchor: int | None = None  # the token before the cut; None at the start of the piece
        self.due = 8 * merges.lookahead

    def feed(self, part: bytes) -> list[int]:
        m, last, back, fits = self.m, self.last, self.back, self.m.fits
        had = len(self.tail)
        text = self.tail + part.decode("latin-1")
        anchor = self.anchor
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
        for end, word in m.words.iter(text):
            if end >= had:
                ends[end - had].append(word)
        for words in ends:
            here = len(last)
            for token, size in words:
                start = here + 1 - size  # counted from the cut
                if start > 0:
                    good = fits(last[start - 1], token)
                elif start == 0:
                    good = m.own(token) if anchor is None else fits(anchor, token)
                else:
                    good = False
                if good:
                    last.append(token)
                    back.append(size)
                    break
            else:
                raise ValueError("no token ends here: the merge list lacks a byte")
        self.tail = text[-(m.lookahead - 1) :] if m.lookahead > 1 else ""
        return self._stable() if len(last) >= self.due else []

    def _stable(self) -> list[int]:
        """Emit what all prefixes within the lookahead share."""
        n = len(self.last)
        live = set(range(n, max(n - self.m.lookahead, 0), -1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - self.back[top - 1])
        cut = live.pop()
        out = self._chain(cut)
        if out:
            self.anchor = out[-1]
            del self.last[:cut], self.back[:cut]
        self.due = len(self.last) + 8 * self.m.lookahead
        return out

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.last[end - 1])
            end -= self.back[end - 1]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._chain(len(self.last))


class Encoder:
    """Text to ids; remembers the ids of short pieces (a bounded number)."""

    def __init__(self, merges: MergeList):
        self.m, self.memo = merges, {}

    def piece(self, text: str) -> list[int]:
        known = self.memo.get(text)
        if known is None:
            raw, t, known = text.encode("utf-8", "replace"), Transducer(self.m), []
            for k in range(0, len(raw), 4096):
                known += t.feed(raw[k : k + 4096])
            known += t.finish()
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_SIZE:
                    self.memo.clear()
                self.memo[text] = known
        return known

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes in parts; holds back no more than the match in progress."""
        held, wait = "", 0
        for part in parts:
            held += part
            if len(held) < wait:
                continue
            at = 0
            for match in PATTERN.finditer(held):
                if match.end() > len(held) - HOLD:
                    break
                yield self.piece(match.group())
                at = match.end()
            held = held[at:]
            wait = 2 * len(held)  # a match that goes on is not scanned again before it has doubled
        for word in PATTERN.findall(held):
            yield self.piece(word)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens (their strings are ordinary text); [] for an empty or null text."""
        ids: list[int] = []
        if not text:
            return ids
        if len(text) <= TEXT_SLICE:
            memo, piece = self.memo, self.piece
            for word in PATTERN.findall(text):
                known = memo.get(word)
                ids += known if known is not None else piece(word)
            return ids
        for known in self.stream(text[k : k + TEXT_SLICE] for k in range(0, len(text), TEXT_SLICE)):
            ids += known
        return ids


class Decoder:
    """Ids to text, in parts: bytes of an unfinished character wait for the next ids; invalid bytes become U+FFFD."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.m.bytes[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(MergeList(path))
    return _ENCODERS[path]


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every document. Null and empty texts give []; a blank text gives its ids.

    Extra columns of documents are left out. No shuffle but for inputs of fewer partitions than cores; texts are taken whole, whatever their length.
    """
    path = path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flat, ends = array("i"), array("i", [0])
                for text in batch.column(1):
                    flat.extend(encode(text.as_py()))
                    ends.append(len(flat))
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], schema=out)

    return spread(documents.selectExpr("cast(doc_id as bigint) as doc_id", "text"), "doc_id").mapInArrow(rows, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document; 0 for null and empty texts."""
    path = path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            sizes = pa.array([len(encode(x.as_py())) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], schema=out)

    return spread(documents.selectExpr("cast(doc_id as bigint) as doc_id", "text"), "doc_id").mapInArrow(rows, "doc_id bigint, n_tokens bigint")


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, ids; null ids give null."""
    path = path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path).m
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                d = Decoder(merges)
                texts.append(None if ids is None else d.feed(ids) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=out)

    return encoded.selectExpr("cast(doc_id as bigint) as doc_id", "ids").mapInArrow(rows, "doc_id bigint, text string")
