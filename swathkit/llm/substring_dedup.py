"""Removal of word windows that earlier documents have, behind a count-min prefilter.

A window is ``WINDOW`` (13) words; it goes if its word sequence starts in a document with a smaller
doc_id too. Pass 1 counts in sketches, one for each part of the input, which are merged; pass 2
groups exactly, by 128-bit keys, only windows that the merged sketch estimates to be repeated.

What the sketch counts for a window is its anchor, the leftmost of its runs of ``GRAM`` words with
the smallest hash. Equal windows have equal anchors, so an anchor's count is never below the
window's: with the usual collisions on top, estimates are too high or right and no repeated window
is lost. Neighbouring windows mostly share an anchor, which makes the sketch 3.5 times smaller.

The exact pass has two steps for the same reason. All windows of an anchor lie in its surroundings,
the words as far as any of them reaches. Documents whose surroundings an earlier document has too
lose all of these windows at once. An anchor with one kind of surroundings is done then: its first
document is the first for each window. For anchors with several, the first documents of each kind
are grouped window by window; they are picked out of the texts by a second bit table, of (anchor,
surroundings, document), whose false hits cost a little work and change nothing.

Surroundings and windows are compared by keys of 128 bits, texts of one doc_id are told apart by
64 bits of their own. Both tables are bounded (see ``_sketch``) and the only data that is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import mix, sliding_argmin, span_digests, text_slices, window_keys, word_spans
from ._sketch import DEPTH, estimated, merged_sketch, of_texts, sketch_bits
from .common import Workspace, arrow_batches, text_key

WINDOW, GRAM = 13, 8
#: Bytes of prose per anchor: 6.6 for a word, 3.5 words to an anchor.
ANCHOR_BYTES = 23


#: Words that the surroundings of an anchor have before it, and in all.
BEFORE, AROUND = WINDOW - GRAM, 2 * WINDOW - GRAM


class Windows:
    """The windows of a slice of texts, in runs that share an anchor.

    Words are kept with ``BEFORE`` empty places before, between and behind texts, so that
    surroundings have the same width everywhere and end where their text does.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, self.of = word_spans(body, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.of))
        at = np.arange(len(owner)) + BEFORE * (owner + 1)
        self.words = np.zeros((2, len(owner) + BEFORE * len(offsets)), np.uint64)
        self.words[:, at] = span_digests(body, starts, ends)
        grams = window_keys(self.words[0], GRAM)
        window = np.flatnonzero(owner[WINDOW - 1 :] == owner[: max(len(owner) - WINDOW + 1, 0)])
        anchor = sliding_argmin(grams, WINDOW - GRAM + 1)[at[window]]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
        self.anchor, self.owner = anchor[first], owner[window[first]]
        self.low, self.high = window[first], window[last]  # counted without the empty places
        self.hash = grams[self.anchor]

    def keep(self, chosen: np.ndarray) -> None:
        """Go on with some of the runs."""
        for name in ("anchor", "owner", "low", "high", "hash"):
            setattr(self, name, getattr(self, name)[chosen])

    def surroundings(self) -> list[np.ndarray]:
        """Two 64-bit keys of each run's surroundings, cut at the ends of its text."""
        return [window_keys(w, AROUND)[self.anchor - BEFORE] for w in self.words]

    def each(self) -> tuple[np.ndarray, ...]:
        """Run, place and two 64-bit keys of every window."""
        n = self.high - self.low + 1
        run = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + self.low[run]
        return run, at, *(window_keys(w, WINDOW)[at + BEFORE * (self.owner[run] + 1)] for w in self.words)


def _of_document(gram: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of (anchor, surroundings, document)."""
    return mix(gram ^ mix(around ^ mix(doc.view(np.uint64))))


def removed_words(docs: DataFrame, work: Workspace, bits: int | None = None) -> DataFrame:
    """(doc, key, places): runs (low, n) of first words of windows to remove, for each document that
    has one; ``key`` tells texts of one doc_id apart."""
    spark = docs.sparkSession
    arrow_batches(spark)
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = sketch_bits(total / ANCHOR_BYTES) if bits is None else bits
    known = docs.where("doc_id IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("key"), "text")
    twice = spark.sparkContext.broadcast(merged_sketch(known.select("text"), bits, of_texts(lambda body, offsets: Windows(body, offsets).hash)).tobytes())

    def runs(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Windows that the sketch estimates to be repeated, with their documents and keys."""
        table = np.frombuffer(twice.value, np.uint8).reshape(DEPTH, -1)
        doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, last, body, offsets in text_slices(batch.column(2)):
            w = Windows(body, offsets)
            w.keep(estimated(table, w.hash, bits))
            yield w, w.surroundings(), doc[first:last][w.owner], key[first:last][w.owner]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, around, doc, key in runs(batch):
                place = (w.low - w.of[w.owner]) << 8 | (w.high - w.low + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w.hash.view(np.int64), *(x.view(np.int64) for x in around), doc, key, place)], names=["gram", "around", "around2", "doc", "key", "place"])

    # Step 1: surroundings that an earlier document has; anchors with several kinds stay open.
    same = ["around", "around2"]
    found = work.save(known.mapInArrow(contexts, "gram long, around long, around2 long, doc long, key long, place long"), "around")
    classes = work.save(found.groupBy("gram", *same).agg(F.min("doc").alias("least"), F.max("doc").alias("most")), "classes", total // 4)
    shared = classes.where("least < most").select(*same, "least")
    settled = work.save(found.join(shared, same).where("doc > least").select("doc", "key", "place"), "settled", total // 8)
    work.drop("around")
    several = work.save(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "several", total // 16)
    left = work.save(classes.join(several, "gram").select("gram", "around", "least"), "left", total // 16)
    work.drop("classes", "several")
    open_bits = sketch_bits(left.count())
    held = spark.sparkContext.broadcast(merged_sketch(left, open_bits, lambda b: iter([_of_document(*(b.column(k).to_numpy().view(np.uint64) for k in range(3)))]), least=1).tobytes())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint8).reshape(DEPTH, -1)
        for batch in batches:
            for w, around, doc, key in runs(batch):
                chosen = estimated(table, _of_document(w.hash, around[0], doc), open_bits)
                w.keep(chosen)
                doc, key = doc[chosen], key[chosen]
                run, at, one, two = w.each()
                place = (at - w.of[w.owner[run]]) << 8 | 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), doc[run], key[run], place)], names=["one", "two", "doc", "key", "place"])

    # Step 2: windows one by one, their smallest document combined before the shuffle.
    each = work.save(known.mapInArrow(windows, "one long, two long, doc long, key long, place long"), "each")
    least = each.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("one", "two", "least")
    later = each.join(least, ["one", "two"]).where("doc > least").select("doc", "key", "place")
    run = F.struct(F.shiftright("place", 8).cast("int").alias("low"), F.col("place").bitwiseAND(255).cast("int").alias("n"))
    # Rows that repeat entirely name the same places: a set holds them once.
    out = work.save(settled.unionByName(later).groupBy("doc", "key").agg(F.collect_set(run).alias("places")), "places", total // 8)
    work.drop("settled", "each", "left")
    return out


def _keep(text: str | None, places: pa.Scalar) -> tuple[bytes, int, int]:
    """Kept words joined by a space, number of words, number of words removed."""
    body = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_spans(body, np.array([0, len(body)]))
    n = len(starts)
    gone = np.zeros(n + 1, np.int64)
    if places.is_valid:
        low, m = (places.values.field(k).to_numpy() for k in range(2))
        np.add.at(gone, low, 1)
        np.add.at(gone, low + m - 1 + WINDOW, -1)
    kept = np.flatnonzero(np.cumsum(gone)[:n] == 0)
    raw = body.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]), n, n - len(kept)


def dedup(docs: DataFrame, work: Workspace, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining text) of every row of ``docs``.

    Null texts have no words. Texts of any length are read whole. A null doc_id is smaller than none and none is smaller than it: such
    rows stay whole. Rows that share a doc_id never remove each other's words, whether their texts
    are equal or not. An empty table gives an empty result; other columns are not read.
    """
    places = removed_words(docs, work, bits)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    joined = keyed.join(places, (F.col("doc_id") == F.col("doc")) & (F.col("_key") == F.col("key")), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_keep(t.as_py(), p) for t, p in zip(*batch.columns[1:], strict=True)]
            kept, n, removed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
