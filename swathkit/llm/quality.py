"""Quality rules with cross-document line frequency per host.

Lines are normalised (lower case, white space runs to one space, trimmed) and hashed; for each
host (the ``source`` of a document) the number of distinct documents that hold a line is counted.
A line goes from a document if ``limit`` or more other documents of the host hold it, at whatever
size the host has; a document is rejected when that takes more than half of its words, or when it
fails a base rule. Exact copies of a document count as documents for every other one, but don't
count against the document itself: a text is not boilerplate for having been copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernels import span_digests, text_slices, window_keys, word_spans
from .common import WORD_PATTERN, Workspace, arrow_batches, carried, restored, text_key

#: Other documents of a host that make a line boilerplate when they hold it too.
LINE_LIMIT = 20
#: Tasks that the copies of one text are dealt to.
SALTS = 32
LEAST_WORDS, MOST_REPEATED = 50, 50
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
_STATS = pa.schema([("_doc", pa.int64()), ("_host", pa.string()), ("_text", pa.int64())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _repeated(*keys: np.ndarray) -> np.ndarray:
    """Marks each entry whose keys are all there twice or more."""
    order = np.lexsort(keys)
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    out = np.empty(len(order), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def text_stats(body: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, of = word_spans(body, offsets)
    n_words = np.diff(of)
    sums = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=sums[1:])  # code points
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sums[ends] - sums[starts], out=total[1:])
    word_chars = total[of[1:]] - total[of[:-1]]
    np.cumsum(_SYMBOLS[body], out=sums[1:])
    n_symbols = sums[offsets[1:]] - sums[offsets[:-1]]
    owner = np.repeat(np.arange(n), n_words)
    # Windows of three words that are found again in their text.
    one, two = span_digests(body, starts, ends)
    grams, grams2 = window_keys(one, 3), window_keys(two, 3)
    n_repeat = np.zeros(n, np.int64)
    if len(grams):
        inside = owner[2:] == owner[:-2]
        again = np.zeros(len(grams), dtype=bool)
        again[inside] = _repeated(grams2[inside], grams[inside], owner[: len(grams)][inside])
        covered = np.zeros(len(one), dtype=bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        n_repeat = np.bincount(owner[covered], minlength=n)
    # Lines that hold a word and equal an earlier line of their text.
    breaks = np.flatnonzero(body == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(body)]
    line_of = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.append(begin[1:], len(body))
    stop = np.minimum(stop, offsets[line_of + 1])
    stop = np.where((stop > begin) & (body[np.maximum(stop - 1, 0)] == 10), stop - 1, stop)
    with_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_of = begin[with_word], stop[with_word], line_of[with_word]
    n_dup = np.zeros(n, np.int64)
    if len(begin):
        key, key2 = span_digests(body, begin, stop)
        order = np.lexsort((begin, key2, key, line_of))
        same = (line_of[order][1:] == line_of[order][:-1]) & (key[order][1:] == key[order][:-1]) & (key2[order][1:] == key2[order][:-1])
        n_dup = np.bincount(line_of[order][1:][same], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, body, offsets in text_slices(batch.column(3)):
            own = [batch.column(k).slice(first, last - first) for k in range(3)]
            yield pa.RecordBatch.from_arrays(own + [pa.array(x, pa.int64()) for x in text_stats(body, offsets)], schema=_STATS)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def document_lines(docs: DataFrame) -> DataFrame:
    """_doc, _host, _text, _at, _line: the lines with a word; _line is a digest of 128 bits."""
    lines = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("source", F.lit("")).alias("_host"), text_key(F.col("text")).alias("_text"), F.posexplode(F.split("text", "\n", -1)).alias("_at", "_raw")).where(F.col("_raw").rlike(WORD_PATTERN))
    return lines.select("_doc", "_host", "_text", "_at", F.unhex(F.md5(normalised(F.col("_raw")))).alias("_line"), F.regexp_count("_raw", F.lit(WORD_PATTERN)).cast("long").alias("_n"))


def boilerplate(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(_host, _line, _held) of the lines that more than ``limit`` documents hold; over all documents."""
    lines = document_lines(docs)
    # Two combining aggregations: one row per line and document, then one per line.
    held = lines.groupBy("_host", "_line", "_doc", "_text").agg(F.lit(1).alias("_one")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_held"))
    return held.where(F.col("_held") > limit)


def copies(docs: DataFrame) -> DataFrame:
    """(_h, _t, _copies) of the texts that more than one document of a host has."""
    own = docs.select(F.coalesce("source", F.lit("")).alias("_h"), text_key(F.col("text")).alias("_t"), F.col("doc_id").alias("_d"))
    return own.groupBy("_h", "_t", "_d").agg(F.lit(1).alias("_one")).groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)


def judge(docs: DataFrame, work: Workspace, limit: int = LINE_LIMIT) -> DataFrame:
    """One row per row of ``docs``: _doc, _host, _text, the counts, n_line_words (words of removed
    lines), _cut (their places), base_failed and kept.

    Null and empty texts have no words and fail the base rules; null sources are one host; null
    doc_ids are kept as they are and told apart by their texts. Rows that repeat entirely are one
    document and get the same verdict. Long texts are read whole. An empty table gives an empty
    result; columns other than doc_id, text and source are not read.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "source")
    above = work.save(boilerplate(docs, limit), "boilerplate")
    # Both tables may be of any size: they are broadcast only where Spark knows them to be below its size limit.
    cut = document_lines(docs).join(above, ["_host", "_line"])
    # Copies of one text may be any share of the rows: salted by document, so that they meet in many tasks.
    salted = copies(docs).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = cut.withColumn("_salt", F.pmod(F.xxhash64("_doc", "_at"), F.lit(SALTS)).cast("int"))
    same = (F.col("_host") == F.col("_h")) & (F.col("_text") == F.col("_t")) & (F.col("_salt") == F.col("_s"))
    cut = of.join(salted, same, "left").where(F.col("_held") - F.coalesce("_copies", F.lit(1)) >= limit)
    cut = cut.groupBy("_doc", "_host", "_text", "_at").agg(F.first("_n").alias("_n"))
    cut = cut.groupBy("_doc", "_host", "_text").agg(F.sum("_n").alias("n_line_words"), F.collect_list("_at").alias("_cut"))
    cut = cut.select(F.col("_doc").alias("_d"), F.col("_host").alias("_h"), F.col("_text").alias("_t"), "n_line_words", "_cut")
    stats = docs.select("doc_id", F.coalesce("source", F.lit("")), text_key(F.col("text")), "text").mapInArrow(_stats, "_doc long, _host string, _text long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    rows = stats.join(cut, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_host") == F.col("_h")) & (F.col("_text") == F.col("_t")), "left").drop("_d", "_h", "_t")
    rows = rows.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = 2 * F.col("n_line_words") > F.col("n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def clean(docs: DataFrame, work: Workspace, limit: int = LINE_LIMIT) -> DataFrame:
    """The documents that pass, without their boilerplate lines, with the columns of ``docs``.

    n_chars, where there is one, counts the code points of the new text. Other columns, whatever
    their names, come back as they are; nulls, empty and long texts, repeated rows and empty
    tables are judged as ``judge`` says, and every row of a kept document stays.
    """
    verdict = judge(docs, work, limit).where("kept").select("_doc", "_host", "_text", "_cut").dropDuplicates(["_doc", "_host", "_text"])
    rows = docs.select(carried(docs), F.col("doc_id").alias("_d"), F.coalesce("source", F.lit("")).alias("_h"), text_key(F.col("text")).alias("_t"))
    rows = rows.join(verdict, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_host")) & (F.col("_t") == F.col("_text")))
    old = F.col("_row").getField("text")
    kept = F.array_join(F.filter(F.split(old, "\n", -1), lambda line, at: ~F.array_contains(F.col("_cut"), at)), "\n")
    text = F.when(F.col("_cut").isNull(), old).otherwise(kept)
    n_chars = F.when(F.col("_cut").isNull(), F.col("_row").getField("n_chars")).otherwise(F.length(kept).cast("long")) if "n_chars" in docs.columns else None
    return restored(rows, docs.columns, text=text, n_chars=n_chars)
