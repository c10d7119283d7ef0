"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints have 64 bits; two link at ``radius`` (2) or fewer differing bits. Distinct
fingerprints only are compared. Cut into radius + 2 = 4 bands, two linked fingerprints agree in at
least 2 bands; for each of the 6 pairs of bands, the fingerprints that agree there form a group.
Groups above ``GROUP_ROWS`` are cut again in the same way by four bands of the bits that are still
free, as often as needed, which loses no link either. All groups that a task then holds are searched
in one index:

- fingerprints are sorted by group and Gray rank, which brings those with few differing bits together;
- runs of them become the leaves of a forest of one tree a group, whose nodes hold the bits that all
  of their fingerprints share (a mask and a pattern), upper nodes only what is common to their children;
- a search adds up, from the root down, the differences between its fingerprint and the shared
  bits of each node, and drops a whole node once that sum exceeds the radius.

Of the links found, those are emitted that join what a search has not joined yet, so a group gives
at most one link fewer than it has members.

``near_classes`` is the same operator for texts that are similar by their word shingles, five words
and a Jaccard similarity of 0.8 unless told otherwise: at that similarity fingerprints differ in
about ten bits, which no index of bits can search, so there the links of fingerprints are the first
candidates, ``_jaccard`` adds those that fingerprints miss, and all are confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _jaccard
from ._kernels import majority_bits, text_slices, word_spans, xxh64
from .common import Workspace, arrow_batches, carried, components, partitions, restored, text_key

RADIUS, BANDS, SEED = 2, 4, 42
SHINGLE_WORDS = 3
#: Members of a group that one task may hold; queries that it searches at once.
GROUP_ROWS, SEARCHED = 4096, 4096
#: Bits of a group that are free to differ, below which it is never cut again: 16 fingerprints at most.
LEAST_FREE = 4
LEAF, FANOUT = 8, 8
_ALL = (1 << 64) - 1


def fingerprints(body: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, word shingles with repeats, XXH64 of seed 42."""
    low = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    starts, ends, of = word_spans(low, offsets)
    n_words = np.diff(of)
    # One space before each word but the first of a text, nothing else between words.
    keep = np.zeros(len(low), dtype=bool)
    sums = np.zeros(len(low) + 1, np.int64)
    np.add.at(sums, starts, 1)
    np.add.at(sums, ends, -1)
    keep[:] = np.cumsum(sums)[:-1] > 0
    first = np.zeros(len(starts), dtype=bool)
    first[of[:-1][n_words > 0]] = True
    gaps = starts[~first] - 1
    low[gaps] = 32
    keep[gaps] = True
    moved = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    text = low[keep].tobytes()
    begin, stop = moved[starts], moved[ends]
    # A text of fewer words than a shingle has one, of all its words.
    n_shingles = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + of[:-1][owner]
    last = np.minimum(at + words, of[1:][owner]) - 1
    return majority_bits(xxh64(np.frombuffer(text, np.uint8), begin[at], stop[last], SEED), n_shingles)


_PRINTS = pa.schema([("doc_id", pa.int64()), ("_text", pa.int64()), ("fp", pa.int64())])


def document_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, _text (a key of the text) and fp (the fingerprint as a signed long) per row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, body, offsets in text_slices(batch.column(2)):
                own = [batch.column(k).slice(first, last - first) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fingerprints(body, offsets, words).view(np.int64))], schema=_PRINTS)

    return docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text").mapInArrow(run, "doc_id long, _text long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the order of the reflected Gray code."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Index of distinct fingerprints in groups, for searches within a Hamming radius of a group."""

    def __init__(self, group: np.ndarray, codes: np.ndarray) -> None:
        order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[order], group[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        self.group = np.cumsum(new) - 1  # the root of each code
        ones, zeros = self.codes, ~self.codes  # bits that are set, or unset, in all below
        root, width = self.group, LEAF
        #: From the leaves up: shared bits, their values, first member one level below, first code.
        self.levels: list[list[np.ndarray]] = []
        while not self.levels or len(ones) > self.group[-1] + 1:
            start = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
            place = np.arange(len(root)) - np.repeat(start, np.diff(np.append(start, len(root))))
            at = np.flatnonzero(place % width == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            below = self.levels[-1][3] if self.levels else np.arange(len(codes))
            self.levels.append([ones | zeros, ones, np.append(at, len(root)), below[at]])
            root, width = root[at], FANOUT
        # What an upper node has counted its children leave out.
        for low, high in zip(self.levels[:-1], self.levels[1:], strict=True):
            free = ~np.repeat(high[0], np.diff(high[2]))
            low[0], low[1] = low[0] & free, low[1] & free

    def pairs(self, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places i (from first to last) and j < i of the fingerprints of a group within the radius."""
        query = np.arange(first, last)
        node, spent = self.group[query], np.zeros(len(query), np.int64)
        for mask, pattern, members, begin in reversed(self.levels):
            spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
            live = (spent <= radius) & (begin[node] < query)
            query, node, spent = query[live], node[live], spent[live]
            n = members[node + 1] - members[node]
            node = np.repeat(members[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, spent = np.repeat(query, n), np.repeat(spent, n)
        good = (node < query) & (np.bitwise_count(self.codes[query] ^ self.codes[node]) <= radius)
        return query[good], node[good]


def group_links(group: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the distinct fingerprints of each group."""
    if not len(codes):
        return codes, codes
    index = GrayIndex(group, codes)
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for first in range(0, len(codes), SEARCHED):
        for i, j in zip(*(x.tolist() for x in index.pairs(first, min(first + SEARCHED, len(codes)), radius)), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    at = np.array(links, np.int64).reshape(-1, 2)
    return index.codes[at[:, 0]], index.codes[at[:, 1]]


def _cuts(mask: int, radius: int) -> list[int]:
    """``mask`` (the bits that agree) with each choice of bands of the free bits that two linked fingerprints may agree in."""
    free = [b for b in range(64) if not mask >> b & 1]
    bands = [sum(1 << b for b in free[k * len(free) // (radius + 2) : (k + 1) * len(free) // (radius + 2)]) for k in range(radius + 2)]
    return [mask | x | y for x, y in combinations(bands, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, work: Workspace, group_rows: int = GROUP_ROWS, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that give all components."""
    spark = prints.sparkSession
    nbytes = 32 * prints.count()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch.column(k).to_numpy() for k in range(3)])
            now = now if rest is None else np.concatenate([rest, now], axis=1)
            new = np.flatnonzero((now[0, 1:] != now[0, :-1]) | (now[1, 1:] != now[1, :-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = now[:, cut:]
            yield found(now[:, :cut])
        if rest is not None:
            yield found(rest)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        a, b = group_links(np.cumsum(new), rows[2].astype(np.int64).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    masks, rows, parts, depth = [0], prints.select("fp", F.lit(0).cast("long").alias("agreed")), [], 0
    while masks:
        cuts = [(m, c) for m in masks for c in _cuts(m, radius)]
        # At most 6 ** 4 short rows: masks of a depth, whatever the input.
        table = spark.createDataFrame([(_signed(m), _signed(c)) for m, c in cuts], "agreed long, mask long")
        banded = rows.join(F.broadcast(table), "agreed").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = work.save(banded.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"groups-{depth}", nbytes)
        held = work.save(banded.join(sizes, ["mask", "key"]), f"held-{depth}", nbytes)
        masks = [c for _, c in cuts if 64 - c.bit_count() > LEAST_FREE] if sizes.where(F.col("n") > group_rows).limit(1).count() else []
        small = held.where(F.col("n") <= group_rows) if masks else held
        parts.append(small.select("mask", "key", "fp").repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(search, "a long, b long"))
        rows, depth = held.where(F.col("n") > group_rows).select("fp", F.col("mask").alias("agreed")), depth + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return work.save(out.distinct(), "links", nbytes)


def classes(docs: DataFrame, work: Workspace, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, _text, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row.

    Texts without a word, null ones included, have fingerprint zero and link like any other.
    Null doc_ids take part, but a component's id is its smallest doc_id that isn't null, and null
    only if there is none. Texts of any length are read whole. Repeated rows give repeated results;
    an empty table an empty one. Columns other than doc_id and text are not read.
    """
    prints = work.save(document_fingerprints(docs), "prints")
    nbytes = 32 * prints.count()
    distinct = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", nbytes)
    roots = components(links(distinct.select("fp"), work, group_rows), work)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = work.save(named, "named", nbytes)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = work.save(named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "components", nbytes)
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "_text", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _simhash_pairs(prints: DataFrame, work: Workspace) -> DataFrame:
    """Pairs (a, b) of texts (t, fp) that SimHash links, through the least text of each fingerprint."""
    least = work.save(prints.groupBy("fp").agg(F.min("t").alias("least")), "least", 16 * prints.count())
    linked = links(least.select("fp"), work)
    far = linked.join(least.select(F.col("fp").alias("a"), F.col("least").alias("_a")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("_b")), "b")
    return prints.join(least, "fp").where("t <> least").select(F.col("t").alias("a"), F.col("least").alias("b")).unionAll(far.select("_a", "_b"))


def near_classes(docs: DataFrame, work: Workspace, words: int = _jaccard.WORDS, similarity: float = _jaccard.SIMILARITY) -> DataFrame:
    """doc_id, _text (a key of the text) and component_id (of texts that chains of pairs connect) per row.

    Pairs are all those whose sets of word shingles are similar enough. Texts without a word are
    alike; null texts, doc_ids, repeated rows and empty tables count as in ``classes``.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select(F.col("_text").alias("t"), "text").dropDuplicates(["t"])
    sets = _jaccard.open_texts(texts, words, similarity, lambda body, offsets: fingerprints(body, offsets, words), work)
    roots = _jaccard.classes(sets, _simhash_pairs(sets.select("t", "fp"), work), work, similarity)
    work.drop("sets")
    return rows.select("doc_id", "_text").join(roots, F.col("_text") == F.col("node"), "left").select("doc_id", "_text", F.coalesce("root", "_text").alias("component_id"))


def dedup(docs: DataFrame, work: Workspace, words: int = _jaccard.WORDS, similarity: float = _jaccard.SIMILARITY) -> DataFrame:
    """One row of each class of ``near_classes``, with the columns of ``docs``: the smallest (doc_id,
    text key), a null doc_id last.

    Rows that repeat the kept one entirely go too; of those, columns besides doc_id and text may
    differ, and one row stays. Columns come back unchanged, whatever their names.
    """
    return keep_least(docs, near_classes(docs, work, words, similarity), work)


def keep_least(docs: DataFrame, named: DataFrame, work: Workspace) -> DataFrame:
    """One row of each component, of rows named by doc_id, _text and component_id."""
    named = work.save(named, "classes").select("component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "_text").alias("x"))
    chosen = named.groupBy("component_id").agg(F.min("x").alias("x")).select(F.col("x.doc_id").alias("_d"), F.col("x._text").alias("_t"))
    chosen = work.save(chosen, "chosen", 32 * named.count())
    rows = docs.select(carried(docs), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_key"))
    joined = rows.join(chosen, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left_semi")
    return restored(joined.dropDuplicates(["_doc", "_key"]), docs.columns)
