"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of ``width`` (200) bytes that covers it also starts anywhere else.
Sorting every suffix of a corpus isn't needed for that: only places that could start a repeated
string are kept in buckets, and buckets are refined until their members agree on ``width`` bytes.

1. Each start p is represented by its anchor: of the ``GRAM``-byte strings inside its 200 bytes,
   the leftmost with the smallest hash. Equal strings have equal anchors, at the same distance
   d = anchor - p, so that whole runs of starts share one row. The anchor's gram is the initial
   bucket of its row. Buckets with one member end here: a bounded sketch of the bucket sizes, merged
   from one for each part of the input, drops nearly all of them before any row is shuffled.
2. Rows of a bucket whose surroundings, as far as any of their starts reach, are the same bytes (by
   128-bit digests) are copies for all of their starts, and go on as one row.
3. What is left of a bucket is refined with bucket pointers: every place of its surroundings begins
   in the bucket of its eight bytes; then places are sorted on the pair (own bucket, bucket of the
   place ``have`` bytes later), which gives the buckets of strings twice as long, and these numbers
   are the pointers that the next step sorts on, from 8 to 16, 32, 64 and 128 bytes, and by two
   overlapping pointers to 200. Places alone in their bucket drop out at each step. Buckets are
   numbered by sorting the bytes themselves, so that this step is exact.

Initial buckets that still have more than ``bucket_rows`` rows in step 3 aren't gathered: their
starts are counted one by one in Spark, by 128-bit digests of their 200 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernels import byte_windows, sliding_argmin, text_slices
from ._sketch import DEPTH, estimated, merged_sketch, of_texts, sketch_bits
from .common import Workspace, arrow_batches, carried, partitions, restored, text_key

WIDTH, GRAM = 200, 64
#: Rows of an initial bucket that one task may gather, and rows that are refined at once.
BUCKET_ROWS, BATCH_ROWS = 8192, 2048
#: Bytes of text per anchor.
ANCHOR_BYTES = 60
#: Stands for a null doc_id in joins.
NULL_ID = -(1 << 63)
_REACH = WIDTH - GRAM  # the largest distance of a start from its anchor


def anchor_runs(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per run of starts with one anchor: the anchor's place, first and last start, gram bucket."""
    n = len(body)
    grams = byte_windows(body, GRAM)
    best = sliding_argmin(grams, _REACH + 1)
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + WIDTH <= text_end)
    at = best[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    at = at[first]
    return at, starts[first], starts[last], grams[at]


def anchors(body: np.ndarray, offsets: np.ndarray, twice: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Per run of starts whose bucket the sketch doesn't call single: text number, anchor's place in
    its text, smallest and largest distance, gram bucket, digest (two values) of the surroundings."""
    at, low, high, gram = anchor_runs(body, offsets)
    kept = estimated(twice, gram, bits)
    at, low, high, gram = at[kept], low[kept], high[kept], gram[kept]
    owner = np.searchsorted(offsets, at, side="right") - 1
    left = np.maximum(at - _REACH, offsets[owner])
    right = np.minimum(at + WIDTH, offsets[owner + 1])
    raw, digest = body.tobytes(), xxhash.xxh3_128_digest
    # How far the surroundings reach on both sides is the digest's seed.
    found = b"".join([digest(raw[a:b], c) for a, b, c in zip(left.tolist(), right.tolist(), ((at - left) * 1024 + (right - at)).tolist(), strict=True)])
    around = np.frombuffer(found, "<i8").reshape(-1, 2)
    return owner, at - offsets[owner], at - high, at - low, gram, around[:, 0], around[:, 1]


_ANCHORS = pa.schema([(n, pa.int64()) for n in ("doc", "text_key", "gram", "around", "around2", "place")])


def anchor_rows(texts: DataFrame, total: int) -> DataFrame:
    """The rows of ``_ANCHORS`` for the anchors that may have company; ``total``: bytes of all texts."""
    bits = sketch_bits(total / ANCHOR_BYTES)
    twice = texts.sparkSession.sparkContext.broadcast(merged_sketch(texts.select("text"), bits, of_texts(lambda body, offsets: anchor_runs(body, offsets)[3])).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(twice.value, np.uint8).reshape(DEPTH, -1)
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last, body, offsets in text_slices(batch.column(2)):
                owner, at, near, far, gram, around, around2 = anchors(body, offsets, table, bits)
                place = at << 16 | near << 8 | far
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first:last][owner], key[first:last][owner], gram.view(np.int64), around, around2, place)], schema=_ANCHORS)

    return texts.mapInArrow(run, "doc long, text_key long, gram long, around long, around2 long, place long")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each listed anchor, padded with zeros outside its text."""
    span = np.arange(-_REACH, WIDTH)
    for batch in batches:
        doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        wanted = batch.column(3)
        for first, last, body, offsets in text_slices(batch.column(2)):
            lists = wanted.slice(first, last - first)
            rows = lists.flatten()
            owner = np.repeat(np.arange(last - first), lists.value_lengths().to_numpy())
            place, gram, alone, size = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for lo in range(0, len(owner), 8192):
                own, own_place = owner[lo : lo + 8192], place[lo : lo + 8192]
                at = (own_place >> 16) + offsets[own]
                index = at[:, None] + span
                inside = (index >= offsets[own][:, None]) & (index < offsets[own + 1][:, None])
                raw = np.where(inside, body[np.clip(index, 0, len(body) - 1)], 0).astype(np.uint8)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(span)), len(own), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc[first:last][own]), pa.array(key[first:last][own]), pa.array(gram[lo : lo + 8192]), pa.array(own_place), pa.array(alone[lo : lo + 8192]), pa.array(size[lo : lo + 8192]), binary], names=["doc", "text_key", "gram", "place", "alone", "size", "context"])


def _numbered(keys: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, int]:
    """Bucket numbers of the live entries by their keys, -1 for those alone in theirs; how many there are."""
    _, inverse, count = np.unique(keys[live], return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    out = np.full(keys.shape, -1, np.int64)
    out[live] = np.where(count[inverse] > 1, number[inverse], -1)
    return out, int((count > 1).sum())


def _starts_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and distance from the anchor of every start."""
    distance = np.arange(_REACH + 1)
    return np.nonzero((distance >= ((place >> 8) & 255)[:, None]) & (distance <= (place & 255)[:, None]))


def refine(place: np.ndarray, alone: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the starts, of rows that were alone, whose string is there twice."""
    width = context.shape[1]
    eight = np.zeros((len(context), width - 7), np.uint64)
    for k in range(8):
        eight |= context[:, k : width - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    # Places that no start's string reaches stay out from the beginning.
    column, far, near = np.arange(width - 7), (place & 255)[:, None], ((place >> 8) & 255)[:, None]
    pointer, n = _numbered(eight, (column >= _REACH - far) & (column + 8 <= _REACH - near + WIDTH))
    have = 8
    while 2 * have <= WIDTH:
        own, later = pointer[:, :-have], pointer[:, have:]
        pointer, n = _numbered(own * n + later, (own >= 0) & (later >= 0))
        have *= 2
    row, d = _starts_of(place)
    own, later = pointer[row, _REACH - d], pointer[row, _REACH - d + WIDTH - have]
    live = (_numbered(own * n + later, (own >= 0) & (later >= 0))[0] >= 0) & alone[row]
    return row[live], d[live]


_RANGES = "doc long, text_key long, low long, high long"


def _table(batch: pa.Table) -> tuple[np.ndarray, ...]:
    batch = batch.combine_chunks()
    n, width = batch.num_rows, _REACH + WIDTH
    context = np.frombuffer(b"".join(batch["context"].to_pylist()), np.uint8).reshape(n, width)
    return (*(batch[c].to_numpy() for c in ("doc", "text_key", "place", "alone")), context)


def _starts(doc: np.ndarray, key: np.ndarray, place: np.ndarray, row: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring starts of a row as ranges."""
    order = np.lexsort((-d, row))
    row, d = row[order], d[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (d[1:] != d[:-1] - 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    at = place[row[first]] >> 16
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc[row[first]], key[row[first]], at - d[first], at - d[last])], names=["doc", "text_key", "low", "high"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of rows that come sorted by bucket, a few thousand rows at a time."""

    def done(part: pa.Table) -> pa.RecordBatch:
        doc, key, place, alone, context = _table(part)
        return _starts(doc, key, place, *refine(place, alone, context))

    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        if rest.num_rows >= BATCH_ROWS:
            gram = rest["gram"].to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield done(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield done(rest)


def _each_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            doc, key, place, alone, context = _table(pa.Table.from_batches([batch.slice(lo, 2048)]))
            row, d = _starts_of(place)
            raw, begin = context.tobytes(), row * context.shape[1] + _REACH - d
            keys = np.frombuffer(b"".join([digest(raw[a : a + WIDTH]) for a in begin.tolist()]), "<i8").reshape(-1, 2)
            arrays = [doc[row], key[row], (place[row] >> 16) - d, alone[row], keys[:, 0], keys[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc", "text_key", "low", "alone", "one", "two"])


def _keys() -> tuple[Column, Column]:
    """_doc (null doc_ids have a number of their own) and _key: which text a row has."""
    return F.coalesce("doc_id", F.lit(NULL_ID)).alias("_doc"), text_key(F.col("text")).alias("_key")


def repeated_starts(docs: DataFrame, work: Workspace, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc, text_key, low, high): all places, low to high, whose string starts elsewhere too."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(*_keys(), "text")
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    held = work.save(anchor_rows(texts, total), "held")
    member = F.struct("doc", "text_key", "place")
    same = ["around", "around2"]
    buckets = work.save(held.groupBy("gram", *same).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("x")), "buckets", total // 4)
    copies = held.join(buckets.where("n > 1").select(*same), same, "left_semi")
    at = F.shiftright("place", 16)
    resolved = work.save(copies.select("doc", "text_key", (at - F.col("place").bitwiseAND(255)).alias("low"), (at - F.shiftright("place", 8).bitwiseAND(255)).alias("high")), "resolved", total // 4)
    work.drop("held")
    # Buckets that step 2 split: those left alone, and one member of each refined bucket.
    split = work.save(buckets.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "split", total // 32)
    rows = buckets.join(split, "gram").select("x.doc", "x.text_key", F.struct("x.place", "gram", (F.col("n") == 1).alias("alone"), "size").alias("member"))
    wanted = work.save(rows.groupBy("doc", "text_key").agg(F.collect_list("member").alias("members")), "wanted", total // 4)
    work.drop("buckets", "split")
    # Rows that repeat entirely are one text here; they have been found to be copies before.
    joined = texts.join(wanted, (F.col("_doc") == F.col("doc")) & (F.col("_key") == F.col("text_key"))).groupBy("_doc", "_key").agg(F.first("text").alias("text"), F.first("members").alias("members"))
    contexts = joined.mapInArrow(_contexts, "doc long, text_key long, gram long, place long, alone boolean, size long, context binary")
    contexts = work.save(contexts, "contexts")
    few = contexts.where(F.col("size") <= bucket_rows).repartition(partitions(spark), "gram").sortWithinPartitions("gram").mapInArrow(_refined, _RANGES)
    parts = [resolved, few]
    if wanted.where(F.exists("members", lambda m: m["size"] > bucket_rows)).limit(1).count():
        starts = contexts.where(F.col("size") > bucket_rows).mapInArrow(_each_start, "doc long, text_key long, low long, alone boolean, one long, two long")
        starts = work.save(starts, "starts")
        twice = starts.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
        parts.append(starts.where("alone").join(twice, ["one", "two"], "left_semi").select("doc", "text_key", "low", F.col("low").alias("high")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def removed_spans(n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the strings that start in the given ranges."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + WIDTH)
    new = np.ones(len(low), dtype=bool)
    new[1:] = low[1:] > end[:-1]
    first = np.flatnonzero(new)
    return low[first], np.minimum(end[np.append(first[1:], len(low)) - 1], n)


def _cut(raw: bytes, ranges: pa.Scalar) -> tuple[bytes, int, int]:
    """Remaining bytes, number of bytes removed, number of runs."""
    if not ranges.is_valid or not len(ranges.values):
        return raw, 0, 0
    begin, stop = removed_spans(len(raw), ranges.values.field(0).to_numpy(), ranges.values.field(1).to_numpy())
    edges = [0, *np.stack([begin, stop], axis=1).ravel().tolist(), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(raw) - len(kept), len(begin)


def with_ranges(docs: DataFrame, work: Workspace, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """_row (the columns of ``docs`` but its text), text, and _ranges: the repeated starts of each row's text, null without one."""
    # A set, since rows that repeat entirely name the same ranges.
    ranges = repeated_starts(docs.select("doc_id", "text"), work, bucket_rows).groupBy("doc", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("_ranges"))
    total = int(docs.agg(F.count(F.lit(1))).first()[0])
    ranges = work.save(ranges, "ranges", 500 * total)
    work.drop("resolved", "wanted", "contexts", "starts")
    rows = docs.select(carried(docs, "text"), *_keys(), "text")
    return rows.join(ranges, (F.col("_doc") == F.col("doc")) & (F.col("_key") == F.col("text_key")), "left").select("_row", "text", "_ranges")


def report(docs: DataFrame, work: Workspace, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Null texts are empty; texts of any length are read whole. Rows with a null doc_id, or one that
    others have too, are documents of their own, told apart by their texts; rows that repeat
    entirely are copies of each other. An empty table gives an empty result; columns other than
    doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                kept, removed, runs = _cut(raw, ranges)
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_ranges(docs.select("doc_id", "text"), work, bucket_rows).select("_row.doc_id", "text", "_ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, work: Workspace, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` without the repeated bytes, with its own columns; n_chars, if there, is counted anew.

    Bytes of a character that was cut in two are dropped with it. Every row stays, be its text
    empty; a null text stays null. Nulls, long texts, repeated rows and empty tables count as
    ``report`` says; other columns, whatever their names, come back as they are.
    """
    rows = with_ranges(docs, work, bucket_rows)
    schema = T.StructType([rows.schema["_row"], T.StructField("_kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                value = text.as_py()
                if value is not None and ranges.is_valid:
                    value = _cut(value.encode(), ranges)[0].decode("utf-8", "ignore")
                texts.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_kept"])

    n_chars = F.coalesce(F.length("_kept"), F.lit(0)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return restored(rows.mapInArrow(run, schema), docs.columns, text=F.col("_kept"), n_chars=n_chars)
