"""Texts as hashed passages: vectorised over the code points of many documents at once.

Arrow's kernels normalise the texts and put a mark in the place of each placeholder; everything after is array work on
one buffer of code points: character classes from a table, words and passages from class changes, word hashes from prefix
sums of a polynomial (mod 2**64), so that neither words nor passages are ever handled one by one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Hashed features and places of a model (to be raised with the variety of the corpus); characters handled at once.
SIZE, PLACES, BLOCK_CHARS = 1 << 18, 1 << 20, 1 << 20
#: Marks of placeholders among code points and among hashed words: plain spellings, and spellings that text uses too.
STRONG, WEAK = 0xFFFF, 0xFFFE
GAP_STRONG, GAP_WEAK = 0xFFFFFFFF, 0xFFFFFFFE
# Bits of a passage's flags.
SLOTTED, SEEDED, REPEATED, ASIDE, TAGGED, TAUGHT = 1, 2, 4, 8, 16, 32

# Spellings of placeholders (fixed values), strong: {{x}} {{{x}}} ${x} $(x) #{x} {!x} {x} <%= x %> {% x %} %x% %%x%% %s @@x@@
# __x__ [[x]] <<x>> <x goes here> *|x|* [insert x] [masukkan x] 「填写x」 (x to be filled in); weak: [x] 【x】 XXXX undefined.
# A blank may be any run of blanks or line breaks. No spelling has a greatest length.
_NAME = r"[\p{L}\p{N}_.\-]+(?:\s*\|\s*[\p{L}\p{N}_]+)?"
STRONG_SLOT = (
    rf"(?i)\{{\{{\{{?\s*{_NAME}\s*\}}\}}\}}?|[$#]\{{\s*{_NAME}\s*\}}|\$\(\s*{_NAME}\s*\)|\{{!?\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\{{%\s*{_NAME}\s*%\}}"
    rf"|%%{_NAME}%%|%[\p{{L}}_.]{{2,}}%|@@{_NAME}@@|__\p{{L}}[\p{{L}}\p{{N}}.]*(?:_[\p{{L}}\p{{N}}.]+)*__|\[\[{_NAME}\]\]|<<{_NAME}>>|\*\|{_NAME}\|\*"
    r"|\[(?:insert|masukkan)\s+[^\[\]]+\]|<[\p{L}\p{N}_.]+\s+goes\s+here>|「填写[^「」]*」|\([\p{L}\p{N}_.]+\s+to\s+be\s+filled\s+in\)"
)
FORMAT_SLOT = r"(^|[^\p{L}\p{N}_%])%[sd]\b"
WEAK_SLOT = r"(?i)\[[\p{L}_.]{2,}\]|【[^【】]+】|\bX{3,}\b|\bundefined\b"
_ENTITY, _HIDDEN = r"&lt;([\p{L}\p{N}_.]+)&gt;", r"[\x{FFFE}\x{FFFF}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}]"
_TAGS, _PAGE = r"(?i)</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", r"(?i)<(?:html|title|noscript|h1)\b"
_LEAD = r"^[\s\-*•>\"“]*"
# How residue begins (fixed values), in lower case.
TRUSTED = _LEAD + (
    r"(?:(?:http\s*|error\s*|ralat\s*|错误\s*)?[45]\d\d\s*(?:$|:|bad request|unauthorized|forbidden|not found|page not found|request timeout|too many requests|internal server error|bad gateway|service unavailable|gateway timeout)"
    r"|(?:http|error|ralat|错误)\s*[45]\d\d|\{\"status\":\s*[45]\d\d|unhandled exception|access denied|akses ditolak|拒绝访问|we are down for maintenance|laman ini sedang diselenggara|网站维护中"
    r"|(?:please |you need to |sila )?(?:enable|aktifkan|启用) ?javascript|请启用 ?javascript|javascript is (?:disabled|required)|this (?:page|site) (?:needs|requires) (?:client-side )?(?:java)?scripts?|laman ini memerlukan|本站需要脚本"
    r"|oops|whoops|oh no|alamak|糟糕|(?:we(?:'|’)?re |we are )?sorry|unfortunately|maaf|harap maaf|抱歉|something went wrong|an? (?:unexpected )?(?:error|fault) occurred|your session has expired|sesi anda telah tamat|登录已过期|the page you|halaman yang anda|您要找的|您没有权限"
    r"|lorem.ipsum|sample text|(?:your )?(?:content|text|copy|description) (?:goes here|to follow|coming soon)|this is a dummy|click to edit|placeholder for|\(?text for|(?:some|a few) words about|here comes the|could not connect|teks contoh|ruang untuk|\(?teks untuk|sedikit ayat tentang|kandungan akan menyusul|此处(?:为示例|放)|这里放|在此输入|文案待补充|测试测试)"
)
# What words speak of placeholders themselves (fixed values), in lower case.
TEACHING = r"\b(?:placeholders?|templates?|templat|variables?|syntax|merge fields?|pemegang tempat)\b|占位符|模板|变量|语法"
# Rights, feedback and loading lines, headings, and short parts between bars, dashes or arrows (page furniture).
FURNITURE = r"(?s)^\s*(?:(?:\(c\)|©).*|all rights reserved\.?|was this page helpful\?.*|yes / no|menu\b.{0,30}|learn how|#{1,6}\s.*|loading\.*|[^|>.!?]{1,25}(?:\s+[|>\-·/]\s+[^|>.!?]{1,25})+)\s*$"

_LETTER, _HAN, _DIGIT, _BLANK, _GAP, _CODE = 1, 2, 3, 4, 5, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2**64
_NUMBER, _CODED = 0x2545F491, 0x5851F42D


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point below 0x20000; those beyond are taken for Han characters."""
    out = np.zeros(0x20001, np.uint8)
    for c in range(0x20000):
        s = chr(c)
        if s.isspace():
            out[c] = _BLANK
        elif s.isdecimal():
            out[c] = _DIGIT
        elif s.isalnum() or unicodedata.category(s)[0] == "M":
            out[c] = _LETTER
    out[0x4E00:0xA000] = _HAN
    out[0x20000] = _HAN
    out[[STRONG, WEAK]] = _GAP
    return out


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 32-bit hash of two arrays of hashes."""
    x = a.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + b.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)
    x ^= x >> np.uint64(32)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _period(word: str) -> str:
    """The shortest text that a word repeats (itself, if it repeats none)."""
    return word[: (word + word).find(word, 1)]


def _repeats(words: list[str]) -> bool:
    """One or two words over and over (test test test, asdf asdf2)."""
    plain = ["x" if w == chr(WEAK) else _period(w) for w in words if not w.isdecimal()]
    if not plain:  # 123 1231 123123
        short = min(map(len, words))
        plain = [w[:short] for w in words]
    few = len(set(plain))
    return few <= 2 and len(plain) >= 3 * few


class Passages:
    """The passages of some documents as arrays: words (hashed), first (word of each passage), chars, flags (of each
    passage) and docs (first passage of each document)."""

    #: The arrays and their types.
    KINDS = (("words", np.uint32), ("first", np.int64), ("chars", np.uint32), ("flags", np.uint8), ("docs", np.int64))

    def __init__(self, words: np.ndarray, first: np.ndarray, chars: np.ndarray, flags: np.ndarray, docs: np.ndarray):
        self.words, self.first, self.chars, self.flags, self.docs = words, first, chars, flags, docs

    def has(self, bit: int) -> np.ndarray:
        return (self.flags & bit) > 0

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums by document of a number per passage."""
        return np.add.reduceat(np.asarray(values, float), self.docs)

    def of_doc(self, values: np.ndarray) -> np.ndarray:
        """A number per document, for each of its passages."""
        return np.repeat(values, np.diff(self.docs, append=len(self.first)))

    def lengths(self) -> np.ndarray:
        return np.diff(self.first, append=len(self.words))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, feature, is it a mark of the whole passage) of words, neighbours and marks, without placeholders."""
        n, h = len(self.words), self.words
        word = h < GAP_WEAK
        inside = np.ones(n, bool)
        inside[self.first] = False
        of = self.owner()
        pair = np.flatnonzero(word[:-1] & word[1:] & inside[1:])
        marks = [np.flatnonzero(self.has(bit)) for bit in (REPEATED, TAGGED, SEEDED)]
        where = np.concatenate([of[word], of[pair], *marks])
        what = np.concatenate([h[word] % SIZE, mixed(h[pair], h[pair + 1], 7) % SIZE, *(np.full(len(m), k, np.uint32) for k, m in enumerate(marks))])
        return where, what.astype(np.int64), np.arange(len(where)) >= word.sum() + len(pair)

    def owner(self) -> np.ndarray:
        """The passage of each word."""
        return np.repeat(np.arange(len(self.first)), self.lengths())

    def places(self, which: np.ndarray) -> list[np.ndarray]:
        """The places of some words: what stands around a word, whatever the word. Its neighbours, these and one more
        before, these and one more after."""
        h, of, n = self.words, self.owner(), len(self.words)

        def beside(step: int) -> np.ndarray:
            at = which + step
            good = (at >= 0) & (at < n)
            at = np.clip(at, 0, n - 1)
            return np.where(good & (of[at] == of[which]), h[at], np.uint32(1 if step < 0 else 2))

        two = mixed(beside(-1), beside(1), 11)
        return [(x % PLACES).astype(np.int64) for x in (two, mixed(two, beside(-2), 12), mixed(two, beside(2), 13))]


def plain_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts in compatibility form and lower case with marks for placeholders and without markup; whether each is a page."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    t = pc.replace_substring_regex(pc.utf8_normalize(t, "NFKC"), _HIDDEN, "")
    t = pc.replace_substring_regex(t, _ENTITY, r"[[\1]]")
    page = pc.match_substring_regex(t, _PAGE).to_numpy(zero_copy_only=False)
    for spelling, mark in ((STRONG_SLOT, chr(STRONG)), (FORMAT_SLOT, r"\1" + chr(STRONG)), (WEAK_SLOT, chr(WEAK))):
        t = pc.replace_substring_regex(t, spelling, mark)
    return pc.utf8_lower(pc.replace_substring_regex(t, _TAGS, "\n\n")), page


def cut_passages(plain: list[str], page: np.ndarray) -> tuple[Passages, np.ndarray]:
    """The passages of some texts (as plain_texts gives them), and the positions of the texts that have any.

    Passages are sentences, paragraphs and list items. Null, empty and blank texts, and those without words, have none.
    """
    one = "\n\n".join(plain) + "\n\n"
    cp = np.frombuffer(one.encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = _classes()[np.minimum(cp, 0x20000)]
    blank = kind == _BLANK
    line = np.concatenate([[0], np.cumsum(cp == 10)])

    # Where passages begin: after sentence ends, blank lines, before list items; a single line break may be mere wrapping.
    edge = np.diff(blank.astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = begins[: len(ends)]  # the last run of blanks ends the buffer
    at = lambda p: cp[np.clip(p, 0, n - 1)]
    stop = np.isin(at(begins - 1), (46, 33, 63)) & (at(begins - 2) != 46)
    breaks = line[ends] - line[begins]
    item = (breaks >= 1) & np.isin(at(ends), (45, 42, 0x2022, 35)) & blank[np.clip(ends + 1, 0, n - 1)]
    fresh = np.zeros(n, bool)
    fresh[0] = True
    fresh[ends[stop | (breaks >= 2) | item]] = True
    han_next = np.append(kind[1:] == _HAN, False)
    full = np.flatnonzero((cp == 0x3002) | (((cp == 33) | (cp == 63)) & han_next)) + 1
    fresh[full[full < n]] = True
    passage = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)

    # Words: runs of letters, numbers (digits, also with points, commas, colons or strokes between), single Han characters,
    # placeholders, and codes (letters, hyphens and digits in a row).
    digit = kind == _DIGIT
    inner = np.flatnonzero(np.isin(cp[1:-1], (44, 46, 47, 58)) & digit[:-2] & digit[2:]) + 1
    kind = kind.copy()
    kind[inner] = _DIGIT
    spelt = (kind == _LETTER) | (kind == _DIGIT)
    hyphen = np.flatnonzero((cp[1:-1] == 45) & spelt[:-2] & spelt[2:]) + 1
    if len(hyphen):
        spelt[hyphen] = True
        edge = np.diff(spelt.astype(np.int8), prepend=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the buffer ends in blanks
        digits = np.concatenate([[0], np.cumsum(kind == _DIGIT)])
        of = np.zeros(len(s), bool)
        of[np.searchsorted(s, hyphen, "right") - 1] = True
        code = np.flatnonzero(of & (digits[e] > digits[s]) & (kind[s] == _LETTER))
        step = np.zeros(n + 1, np.int8)
        step[s[code]], step[e[code]] = 1, -1
        kind = np.where(np.cumsum(step[:-1]) > 0, np.uint8(_CODE), kind)
    before, after = np.concatenate([[0], kind[:-1]]), np.append(kind[1:], 0)
    single = (kind == _HAN) | (kind == _GAP)
    run = (kind == _LETTER) | (kind == _DIGIT) | (kind == _CODE)
    s = np.flatnonzero(single | (run & (before != kind)))
    e = np.flatnonzero(single | (run & (after != kind))) + 1
    up, down = _powers_upto(n + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cp.astype(np.uint64) * up[:n])])
    h = (prefix[e] - prefix[s]) * down[s]
    h ^= h >> np.uint64(29)
    h = ((h * _BASE) >> np.uint64(32)).astype(np.uint32)
    h = np.where(h >= GAP_WEAK, np.uint32(0), np.where(kind[s] == _DIGIT, np.uint32(_NUMBER), np.where(kind[s] == _CODE, np.uint32(_CODED), h)))
    gap = kind[s] == _GAP
    h = np.where(gap, np.where(cp[s] == STRONG, np.uint32(GAP_STRONG), np.uint32(GAP_WEAK)), h)
    owner = passage[s]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    kept = owner[first]  # passages with words
    bounds = np.append(heads, n)

    inked = np.concatenate([[0], np.cumsum(~blank)])
    chars = (inked[bounds[kept + 1]] - inked[bounds[kept]]).astype(np.uint32)
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    offset = np.concatenate([[0], np.cumsum(width)])[bounds]
    strings = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(one.encode())).take(pa.array(kept))
    strings = pc.replace_substring_regex(strings, r"[\s\p{Z}]+", " ")
    match = lambda pattern: pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)

    where = np.cumsum([0, *(len(t) + 2 for t in plain[:-1])])
    doc = np.searchsorted(where, bounds[kept], "right") - 1
    docs = np.flatnonzero(np.diff(doc, prepend=-1))
    slotted = np.add.reduceat(gap, first) > 0 if len(first) else np.empty(0, bool)

    repeated = np.zeros(len(first), bool)
    if len(first):
        # Words of at most two shapes have at most two first characters (numbers aside); few passages do, and these are looked at.
        initial, place, size = np.where(kind[s] == _DIGIT, 0, cp[s]), np.arange(len(s)), np.diff(first, append=len(s))
        other = initial > 0
        for _ in range(2):
            lead = np.minimum(np.minimum.reduceat(np.where(other, place, len(s)), first), len(s) - 1)
            other &= initial != np.repeat(initial[lead], size)
        few = ~np.logical_or.reduceat(other, first)
        stops = np.append(first[1:], len(s))
        for k in np.flatnonzero(few & (size >= 3)):
            words = [one[s[i] : e[i]] for i in range(first[k], stops[k]) if cp[s[i]] != STRONG]
            repeated[k] = bool(words) and _repeats(words)
    flags = SLOTTED * slotted + SEEDED * (match(TRUSTED) | repeated) + REPEATED * repeated + ASIDE * (match(FURNITURE) & ~slotted) + TAGGED * (page[doc] if len(doc) else page[:0])
    taught = np.zeros(len(first), bool)
    which = np.flatnonzero(slotted)
    taught[which] = pc.match_substring_regex(strings.take(pa.array(which)), TEACHING).to_numpy(zero_copy_only=False)
    return Passages(h, first, chars, (flags + TAUGHT * taught).astype(np.uint8), docs), doc[docs] if len(docs) else docs


def joined(parts: list[Passages]) -> Passages:
    """The passages of the parts of one document as one."""
    starts = np.cumsum([0, *(len(p.words) for p in parts[:-1])])
    return Passages(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("words",)), np.concatenate([p.first + s for p, s in zip(parts, starts)]), np.concatenate([p.chars for p in parts]), np.concatenate([p.flags for p in parts]), np.zeros(1, np.int64))


def _parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts of at most `size` characters, cut where a passage ends (failing that, at the last blank)."""
    while len(text) > size:
        at = max(text.rfind(x, 0, size) + len(x) for x in ("\n\n", ". ", "。"))
        at = at if at > 1 else text.rfind(" ", 0, size) + 1 or size
        yield text[:at]
        text = text[at:]
    yield text


def blocks(ids: list[int], texts: pa.Array, size: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, Passages]]:
    """(ids, passages) of the texts that have passages, for about `size` characters at a time; a longer text is alone."""
    t, page = plain_texts(texts)
    plain, begin, total = t.to_pylist(), 0, 0
    for end, text in enumerate([*plain, None]):
        if end > begin and (text is None or total + len(text) > size):
            if total > size:  # one long text
                parts = [found for part in _parts(plain[begin], size) if len((found := cut_passages([part], page[begin : begin + 1])[0]).first)]
                if parts:
                    yield np.array(ids[begin:end], np.int64), joined(parts)
            else:
                found, kept = cut_passages(plain[begin:end], page[begin:end])
                if len(kept):
                    yield np.array(ids[begin:end], np.int64)[kept], found
            begin, total = end, 0
        total += len(text or "")
