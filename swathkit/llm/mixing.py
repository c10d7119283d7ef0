"""Mixing sources to target weights, with DataFrame functions only.

Weighted order without replacement (Efraimidis-Spirakis): a document of weight w gets the
exponential key -ln(u)/w, u being uniform and drawn from a digest of the document, so that
reruns and other partitionings give the same order. Within a source the keys are sorted and
sizes are prefix-summed to the token budget. Complete epochs come first: a target of 2.3 times a
source takes every document twice, and the remaining 0.3 in key order.

A source may hold any share of the rows, so prefix sums have two levels: the keys of a source
fall into buckets between quantiles of these keys, which hold about as many rows each whatever the
weights are; bucket totals are summed over the few buckets, and a window orders the rows inside a
bucket. No task holds a whole source. Where the bounds lie changes no result, only who sorts what.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Workspace, named

#: Rows that a bucket of keys holds on average, and buckets of a source at most: beyond 4 million
#: rows buckets grow, which a sorting task takes. Rows of a source that its bounds are read off.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 4096, 1024, 1 << 16
#: A source is taken at most this many times.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(*columns: Column, salt: str = "mix") -> Column:
    """A uniform number in (0, 1) from an MD5 digest: 52 bits, moved half a step from 0."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, total: Column | None = None, most: float = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight): total shared by weight, at most
    ``most`` times the size each, the excess reshared by weight until none is above.

    Sources sorted by size/weight reach their limit in that order, so the number of limited
    sources follows from prefix sums over the table of sources: one row per source, which is
    small beside the documents.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    full = sources.withColumn("_all", F.sum("source_size").over(every) if total is None else total)
    full = full.withColumn("_cap_before", F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    full = full.withColumn("_weight_from", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # With the sources before this one at their limit, this is what a unit of weight gets.
    full = full.withColumn("_level", (F.col("_all") - F.col("_cap_before")) / F.col("_weight_from"))
    full = full.withColumn("_limited", F.col("_level") * F.col("weight") > most * F.col("source_size"))
    level = F.min(F.when(~F.col("_limited"), F.struct(F.row_number().over(order).alias("k"), F.col("_level").alias("level")))).over(every)
    full = full.withColumn("_free", level)
    target = F.when(F.col("_limited"), most * F.col("source_size")).otherwise(F.col("_free.level") * F.col("weight"))
    return full.withColumn("target", F.coalesce(target, F.lit(0.0)).cast("double")).select(*sources.columns, "target")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights in turn to the sources sorted by code point, null last."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))


def length_quality(size: Column) -> Column:
    """The weight that the registered query uses: 0.25 for an empty text, 1 from 400 words on."""
    return 0.25 + 0.75 * F.least(size, F.lit(400)) / 400.0


def mix(docs: DataFrame, work: Workspace, carry: list[str], quality: Callable[[Column], Column] = length_quality) -> DataFrame:
    """Every row of ``docs``: ``_row`` (a struct of the columns in ``carry``), size, source_size,
    target, times (how often the mix takes it) and taken (words, repeats counted).

    ``quality`` gives the weight of a document in the order of its source from its size; at or
    below zero and null count as the smallest weight, 1e-6. A document is taken in the fractional
    pass while at least half of it lies before the end of the budget, so that a source misses its
    target by at most half of one document. Null texts have size 0; a null source is a source of its
    own; rows that repeat entirely get different draws only through their text digest, so that
    ties are ordered by (doc_id, text) and equal rows, being interchangeable, by any order. An
    empty table gives an empty result. Columns in ``carry`` come back unchanged, whatever their names.
    """
    own = F.struct(*[named(c) for c in carry]).alias("_row")
    sized = docs.select(own, "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    weight = F.greatest(F.coalesce(quality(F.col("size")).cast("double"), F.lit(1e-6)), F.lit(1e-6))
    keyed = sized.withColumn("_key", -F.log(uniform(F.col("doc_id"), F.col("_text"))) / weight)
    # Texts are counted and digested once; those that are carried themselves, once more at the end.
    narrow = work.save(keyed.drop("_row") if "text" in carry else keyed, "sized")
    keyed = keyed if "text" in carry else narrow
    totals = work.save(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")), "totals", 0)
    totals = work.save(totals.join(quantiles(narrow, totals), F.col("source").eqNullSafe(F.col("_q")), "left").drop("_q"), "sources", 0)
    aimed = targets(cyclic_weights(totals))
    plan = aimed.select(F.col("source").alias("_source"), "source_size", "target", bounds().alias("_bounds"), epochs().alias("_epochs")).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = work.save(plan, "plan", 0)
    # The table of sources joins without a shuffle where Spark finds it small, by its size limit.
    placed = keyed.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_bucket", bucket()).drop("_source", "_bounds")
    sums = narrow.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_bucket", bucket()).groupBy(F.col("source").alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("size").alias("_in"))
    before = sums.withColumn("_before", F.sum("_in").over(W.partitionBy("_s").orderBy("_b")) - F.col("_in")).drop("_in")
    before = work.save(before, "before", 0)
    rows = placed.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    run = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "_text").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = F.coalesce(F.col("_before"), F.lit(0)) + F.sum("size").over(run) - F.col("size")
    extra = (F.col("_epochs") < MOST_EPOCHS) & (F.col("size") > 0) & (ahead + F.col("size") / 2 <= F.col("_rest"))
    times = F.col("_epochs") + F.when(extra, 1).otherwise(0)
    return rows.select("_row", "size", "source_size", "target", times.cast("int").alias("times")).withColumn("taken", F.col("times") * F.col("size"))


def quantiles(narrow: DataFrame, totals: DataFrame) -> DataFrame:
    """(_q, _bounds): MOST_BUCKETS - 1 quantiles of the keys of each source ``_q``, from about SAMPLED of its
    rows, drawn by a digest. They decide which task sorts a row, and nothing else."""
    known = totals.select(F.col("source").alias("_q"), "_n")
    drawn = narrow.join(known, F.col("source").eqNullSafe(F.col("_q"))).where(uniform(F.col("doc_id"), F.col("_text"), salt="bounds") * F.col("_n") < SAMPLED)
    return drawn.groupBy("_q").agg(F.approx_percentile("_key", [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)], SAMPLED // 4).alias("_bounds"))


def bounds() -> Column:
    """Of the quantiles ``_bounds`` of a source those that leave ``_n`` rows about BUCKET_ROWS a bucket."""
    buckets = F.least(F.ceil(F.col("_n") / BUCKET_ROWS), F.lit(MOST_BUCKETS)).cast("int")
    place = F.transform(F.sequence(F.lit(1), F.greatest(buckets - 1, F.lit(1))), lambda i: F.element_at("_bounds", F.greatest(F.floor(i * MOST_BUCKETS / buckets), F.lit(1)).cast("int")))
    return F.when(buckets > 1, place).otherwise(F.array().cast("array<double>"))


def bucket() -> Column:
    """How many of the sorted ``_bounds`` are below ``_key``, by binary search."""
    steps = F.array(*[F.lit(MOST_BUCKETS >> k) for k in range(MOST_BUCKETS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) < F.col("_key"), at + step).otherwise(at))


def epochs() -> Column:
    """Whole passes over a source that its target holds."""
    return F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(MOST_EPOCHS))).otherwise(F.lit(0)).cast("long")
