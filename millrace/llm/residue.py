"""Template residue, filler, error pages and scripts-required notices in place of real content.

Two positive-unlabelled naive Bayes mixtures over hashed features of passages (llm/passages.py), fitted by expectation
maximisation over all documents until the expected mass of both settles:

* residue against content. Positives are the passages that begin as error pages, notices or filler do, or merely repeat a
  word, in documents that mostly consist of such; every other passage is unlabelled. Features are words, neighbours and
  two marks (mere repetition, markup of a page). Each document has a share of residue of its own, drawn to the corpus's
  share, so wording that goes along with trusted passages is learned, and a lone odd sentence among content is not.
* explained against unfilled placeholders. Passages without placeholder are trusted as ordinary, passages with one that
  speak of templates are trusted as explaining; the rest is unlabelled. Words that occur without placeholders, and above
  all places (the words before and after) where text has other values, mean that a placeholder was left unfilled.
  Spellings that text uses for other ends too ([word], XXX, undefined) need such a place.

A document is residue if it has an unfilled placeholder, or if the residue of its passages outweighs its content. Page
furniture and headings count for neither. The models are SIZE numbers each, whatever the corpus; each iteration sums
partial counts of the tasks, so nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.passages import ASIDE, GAP_STRONG, GAP_WEAK, PLACES, SEEDED, SIZE, SLOTTED, TAUGHT, Passages, blocks
from millrace.session import spread, written

#: Smoothing of counts; greatest weight of a feature around placeholders (log ratio); EM ends when neither expected mass
#: moves by more than this share of itself, or after so many iterations.
SMOOTH, MOST_WEIGHT, SETTLED, ITERATIONS = 0.5, 4.0, 0.02, 8
#: How much more frequent around placeholders than elsewhere words must be, to be taken for explaining at first.
LEAD = 20.0
#: As how many independent features a passage's words count (evidence is normalised by length), and each mark.
TEMPER, MARK = 3.0, 6.0
#: A document's share of residue is drawn to the corpus's as if that were a text of so many characters.
OWN = 40.0
#: The beginning share of explaining passages among those with placeholders.
SHARE_EXPLAINED = 0.2
#: Log odds against a placeholder of those spellings that text also uses for other ends.
WEAK_DOUBT = 3.0
#: Numbers that an iteration sums besides the counts.
SUMS = 6
PASSAGES = "ids binary, words binary, first binary, chars binary, flags binary, docs binary"


Counts = tuple[np.ndarray, ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _ratio(favour: np.ndarray, against: np.ndarray, discount: float = 0.0, lead: float = 1.0, most: float = MOST_WEIGHT) -> np.ndarray:
    """Log ratios of two smoothed distributions; what neither has counts 0. discount: taken off the counts in favour, so
    that what was seen only once in favour says nothing. lead: how often more frequent a feature must be to speak in favour."""
    f = np.maximum(favour - discount, 0)
    k = lead * max(f.sum(), 1.0) / max(against.sum(), 1.0)
    return np.clip(np.log((f / k + SMOOTH) / (against + SMOOTH)), -most, most).astype(np.float32)


class Models:
    """Log ratios of the features of residue and of explaining passages and of places, and the log odds of explaining."""

    def __init__(self, fixed: Counts, counts: Counts, sums: np.ndarray, first: bool):
        lead = LEAD if first else 1.0
        ordinary, places = fixed
        residue, explained, around = counts
        self.residue = _ratio(residue, ordinary - residue, most=10.0)
        self.explained = _ratio(explained, ordinary, 1.0, lead)
        places = np.maximum(places - np.median(places), 0)  # less what unrelated places add to a cell
        self.places = _ratio(around, places, 1.0, lead * 3)  # of the three kinds only the nearest is counted around placeholders
        self.known = _ratio(np.zeros(PLACES), places)
        self.share = min(max(sums[0] / max(sums[5], 1.0), 1e-4), 0.5)
        # Odds of explaining without and with words that speak of placeholders, smoothed by one of each kind.
        self.odds = np.log((sums[[1, 3]] + 1) / (sums[[2, 4]] - sums[[1, 3]] + 1))


class Scored:
    """Passages with what the models read in them, worked out once."""

    def __init__(self, p: Passages):
        self.p, self.n = p, len(p.first)
        self.where, self.what, mark = p.features()
        self.slots = np.flatnonzero(p.words >= GAP_WEAK)
        self.of, self.places = p.owner()[self.slots], p.places(self.slots)
        self.marks = np.where(mark, MARK, 1.0)
        self.slot, self.aside = p.has(SLOTTED), p.has(ASIDE)
        self.weight = np.where(self.aside, 0.0, p.chars)

    def residue(self, m: Models | None) -> np.ndarray:
        """The probability that each passage is residue.

        Without a model: 1 for the seeded, for others the share of such in their document.
        """
        p, weight, seeded = self.p, self.weight, self.p.has(SEEDED)
        share = lambda q: p.of_doc((OWN * m.share + p.by_doc(q * weight)) / (OWN + p.by_doc(weight)))
        if m is None:
            return np.where(seeded, 1.0, np.where(self.aside, 0.0, p.of_doc(p.by_doc(weight * seeded) / np.maximum(p.by_doc(weight), 1.0))))
        own = TEMPER * np.bincount(self.where, self.marks * m.residue[self.what], self.n) / np.maximum(np.bincount(self.where, self.marks, self.n), 1.0)
        q = _sigmoid(own)
        for _ in range(4):
            s = share(q)
            q = _sigmoid(own + np.log(s / (1 - s)))
        return q

    def explained(self, m: Models | None) -> np.ndarray:
        """The probability of each placeholder that it is none that was left unfilled.

        Neighbours repeat what words say, so n features count as half. A spelling that text also uses for other ends is
        one only in a place where, with one more word on either side, text has other values.
        """
        of, taught = self.of, self.p.has(TAUGHT)[self.of]
        if m is None:
            return np.where(taught, 1.0, SHARE_EXPLAINED)
        near, left, right = self.places
        around = (np.bincount(self.where, m.explained[self.what], self.n) / 2)[of]
        weak = WEAK_DOUBT + 2 * np.maximum(m.known[left], m.known[right]) + np.maximum(around, 0)
        return _sigmoid(m.odds[taught.astype(int)] + np.where(self.p.words[self.slots] == GAP_STRONG, around + 2 * m.places[near], weak))

    def fixed(self) -> Counts:
        """Counts of the features and places of ordinary passages."""
        free = ~self.slot
        return np.bincount(self.what, free[self.where], SIZE), sum(np.bincount(x, minlength=PLACES) for x in self.p.places(np.flatnonzero(free[self.p.owner()])))

    def counts(self, m: Models | None) -> tuple[Counts, np.ndarray]:
        """Expected counts of the features of residue and of explaining passages and of the places of explaining ones;
        sums: residue, and explaining and all placeholders without and with words that speak of placeholders; passages
        without placeholder."""
        q, x = np.where(self.slot, 0.0, self.residue(m)), self.explained(m)
        each, taught = np.zeros(self.n), self.p.has(TAUGHT)[self.of]
        np.maximum.at(each, self.of, x)
        count = lambda w: np.bincount(self.what, w[self.where], SIZE)
        return (count(q), count(each), np.bincount(self.places[0], x, PLACES)), np.array([q.sum(), x[~taught].sum(), (~taught).sum(), x[taught].sum(), taught.sum(), (~self.slot).sum()])

    def decide(self, m: Models) -> np.ndarray:
        """Whether each document is residue."""
        q, weight = self.residue(m), self.weight
        left = np.zeros(self.n)
        np.maximum.at(left, self.of, self.explained(m) < 0.5)
        return (self.p.by_doc(left) > 0) | (self.p.by_doc(weight * q) > self.p.by_doc(weight * (1 - q)))


def _packed(ids: np.ndarray, p: Passages) -> list[bytes]:
    return [ids.tobytes(), *(getattr(p, name).astype(kind).tobytes() for name, kind in Passages.KINDS)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Passages]]:
    """What encode_passages packed."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(row[0], np.int64), Passages(*(np.frombuffer(x, kind) for x, (_, kind) in zip(row[1:], Passages.KINDS)))


def encode_passages(documents: DataFrame) -> DataFrame:
    """PASSAGES of all documents with any word, a row per block of documents: the texts are cut once, all else reads these."""
    schema = pa.schema([(c.split()[0], pa.binary()) for c in PASSAGES.split(", ")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, p in blocks(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _packed(ids, p)], schema=schema)

    return spread(documents.selectExpr("cast(doc_id as bigint) as doc_id", "text"), "doc_id").mapInArrow(encode, PASSAGES)


def fit(documents: DataFrame, iterations: int = ITERATIONS) -> Models:
    """The models, from all documents (doc_id, text; null and empty ones say nothing)."""
    return fit_passages(written(encode_passages(documents), "passages"), iterations)


def fit_passages(table: DataFrame, iterations: int = ITERATIONS) -> Models:
    """The models, from a table of PASSAGES."""
    schema = pa.schema([("kind", pa.int32()), ("feature", pa.int32()), ("value", pa.float64())])
    sizes = (SIZE, SIZE, PLACES, SUMS, SIZE, PLACES)  # residue, explained, their places, sums; once: ordinary, places
    models: Models | None = None
    before, fixed = np.zeros(SUMS), ()
    for step in range(iterations):
        shared = table.sparkSession.sparkContext.broadcast(models)  # 2 * SIZE + 2 * PLACES numbers

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value  # noqa: B023
            totals = [np.zeros(n) for n in (sizes if m is None else sizes[:4])]
            for _, p in _blocks(batches):
                scored = Scored(p)
                counts, sums = scored.counts(m)
                for total, part in zip(totals, (*counts, sums, *(scored.fixed() if m is None else ()))):
                    total += part
            for kind, total in enumerate(totals):
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)

        got = table.mapInArrow(count, "kind int, feature int, value double").groupBy("kind", "feature").agg(F.sum("value").alias("value")).toArrow()  # at most sum(sizes) rows
        kinds, features, values = (got.column(c).to_numpy() for c in ("kind", "feature", "value"))
        totals = [np.bincount(features[kinds == k], values[kinds == k], n) for k, n in enumerate(sizes)]
        fixed = fixed or tuple(totals[4:])
        models, sums = Models(fixed, tuple(totals[:3]), totals[3], step == 0), totals[3]
        shared.unpersist()
        if step > 1 and (np.abs(sums - before)[:2] <= SETTLED * np.maximum(before[:2], 1)).all():
            break
        before = sums
    assert models
    return models


def find_residue(documents: DataFrame, models: Models | None = None) -> DataFrame:
    """doc_id of the documents to exclude. Null, empty and blank texts are none; texts are scored whole."""
    table = written(encode_passages(documents), "passages")
    shared = documents.sparkSession.sparkContext.broadcast(models or fit_passages(table))
    schema = pa.schema([("doc_id", pa.int64())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, p in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids[Scored(p).decide(shared.value)], pa.int64())], schema=schema)

    return table.mapInArrow(decide, "doc_id bigint")
