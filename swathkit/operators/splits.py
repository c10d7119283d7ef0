"""Withholding, folds, regions, gauge screening, censuses and epochs."""

from __future__ import annotations

import datetime as dt
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, in_range
from .ordered import running

#: The box of the regions, the cell size, guard ring, fold sizes and salts.
BOX_LON, BOX_LAT, CELL, CELLS, GUARD = 295.0, 33.0, 2.0, 5, 0.5
FOLD_SIZES = (7, 6, 6, 6)


def leave_mission_out(obs: DataFrame, missions: tuple[str, ...]) -> DataFrame:
    return obs.withColumn("label", F.when(F.col("mission").isin(*missions), "VALIDATION").otherwise("TRAIN"))


def mission_split(obs: DataFrame, locked: tuple[str, ...], validation: tuple[str, ...]) -> DataFrame:
    return obs.withColumn("label", F.when(F.col("mission").isin(*locked), "locked").when(F.col("mission").isin(*validation), "validation").otherwise("train"))


def temporal_fraction(obs: DataFrame, train: float, buffer: float) -> DataFrame:
    """By rank in time within a mission: int(n train) TRAIN, int(n buffer) BUFFER_DISCARD, the rest VALIDATION."""
    ranked = running(obs, ["mission"], F.floor("t"), ["t", "seq"], F.lit(1), "_rank")
    rank, n = F.col("_rank") - 1, F.col("_all")
    first = F.floor(n * train)
    return ranked.withColumn("label", F.when(rank < first, "TRAIN").when(rank < first + F.floor(n * buffer), "BUFFER_DISCARD").otherwise("VALIDATION")).drop("_rank", "_all")


def block_id(lon: Column, t: Column, degrees: float = 2.0, days: float = 7.0) -> Column:
    """Blocks of 2 degrees by 7 days; latitude plays no part."""
    return (F.floor(lon / degrees) * 1000 + F.floor(t / days)).cast("long")


def block_labels(blocks: list[int], seed: int) -> dict[int, str]:
    """20 % locked, 20 % validation of the sorted blocks after a seeded shuffle."""
    order = np.array(sorted(blocks))
    np.random.default_rng(seed).shuffle(order)
    k = int(len(order) * 0.2)
    return {int(b): "locked" if i < k else "validation" if i < 2 * k else "train" for i, b in enumerate(order)}


def block_split(obs: DataFrame, seed: int = 0) -> DataFrame:
    """Blocks are a few per degree and week; their labels join back as a table."""
    spark = obs.sparkSession
    keyed = obs.withColumn("block", block_id(F.col("lon"), F.col("t")))
    labels = block_labels([r[0] for r in keyed.select("block").distinct().collect()], seed)
    return keyed.join(spark.createDataFrame(list(labels.items()), "block long, label string"), "block")


def split(obs: DataFrame, by: str, locked: tuple[str, ...] = ("c2",), validation: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    if by == "mission":
        return mission_split(obs, locked, validation)
    if by == "block":
        return block_split(obs, seed)
    raise ValueError(f"refused: splits by {by!r} leak between neighbours")


def month_folds(points: DataFrame) -> DataFrame:
    """Six rotations of month pairs: fold, and whether a point is scored (else fitted) in it."""
    pair = F.floor((F.col("month") - 1) / 2).cast("int")
    return points.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("score", pair == F.col("fold"))


def cell_index(lon: Column, lat: Column) -> tuple[Column, Column]:
    """5 by 5 cells of 2 degrees, points outside moved in."""
    one = lambda x, low: F.least(F.greatest(F.floor((x - low) / CELL), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    return one(lon, BOX_LON), one(lat, BOX_LAT)


def fold_layout(salt: int) -> tuple[frozenset[int], ...]:
    """A seeded permutation of the 25 cells in groups of 7, 6, 6 and 6."""
    order = np.random.default_rng(salt).permutation(CELLS * CELLS)
    edges = np.cumsum((0, *FOLD_SIZES))
    return tuple(frozenset(int(b) for b in order[a:b]) for a, b in pairwise(edges))


def layout_table(spark: SparkSession, layout: tuple[frozenset[int], ...]) -> DataFrame:
    rows = [(k, b, BOX_LON + CELL * (b % CELLS), BOX_LAT + CELL * (b // CELLS)) for k, fold in enumerate(layout) for b in sorted(fold)]
    return spark.createDataFrame(rows, "fold int, held int, west double, south double")


def space_folds(points: DataFrame, layout: tuple[frozenset[int], ...]) -> DataFrame:
    """For each point and fold: role ``score`` in the fold's cells, ``guard`` within half a degree of
    one (in neither part), else ``fit``."""
    blocks = layout_table(points.sparkSession, layout).groupBy("fold").agg(F.collect_list(F.struct("held", "west", "south")).alias("cells"))
    ix, iy = cell_index(F.col("lon"), F.col("lat"))
    own = iy * CELLS + ix
    near = F.exists("cells", lambda c: in_range("lon", -1e9, 1e9) & (F.col("lon") >= c["west"] - GUARD) & (F.col("lon") <= c["west"] + CELL + GUARD) & (F.col("lat") >= c["south"] - GUARD) & (F.col("lat") <= c["south"] + CELL + GUARD))
    held = F.exists("cells", lambda c: c["held"] == own)
    role = F.when(held, "score").when(near, "guard").otherwise("fit")
    # Four fold rows of at most 25 cells each.
    return points.join(F.broadcast(blocks)).withColumn("role", role).drop("cells")


def layout_respects(points: DataFrame, layout: tuple[frozenset[int], ...], least: float = 0.5) -> DataFrame:
    """fold, label, share of points on the fit side, and whether each label keeps enough of them."""
    shares = space_folds(points, layout).groupBy("fold", "label").agg(F.avg(F.when(F.col("role") == "fit", 1.0).otherwise(0.0)).alias("fit_share"))
    return shares.withColumn("respected", F.col("fit_share") >= least)


def merge_small_blocks(layout: tuple[frozenset[int], ...], n_eff: dict[int, float], least: float = 200.0) -> dict[int, int]:
    """Each block's merged block: those below ``least`` go to the nearest block of their fold, smallest first."""
    target = {b: b for fold in layout for b in fold}
    for fold in layout:
        size = {b: n_eff.get(b, 0.0) for b in fold}
        while len(size) > 1 and min(size.values()) < least:
            small = min(size, key=lambda b: (size[b], b))
            others = [b for b in size if b != small]
            near = min(others, key=lambda b: ((b % CELLS - small % CELLS) ** 2 + (b // CELLS - small // CELLS) ** 2, b))
            size[near] += size.pop(small)
            target = {b: near if t == small else t for b, t in target.items()}
    return target


def region_masks(points: DataFrame, jet: DataFrame) -> DataFrame:
    """One row for each point and class that it is in: SW, SE, NW, NE, jet_core and aggregate."""
    ix, iy = cell_index(F.col("lon"), F.col("lat"))
    joined = points.withColumn("ix", ix).withColumn("iy", iy).join(jet, ["ix", "iy"], "left")
    west, south = F.col("lon") < BOX_LON + 5, F.col("lat") < BOX_LAT + 5
    quadrant = F.when(south & west, "SW").when(south, "SE").when(west, "NW").otherwise("NE")
    classes = F.array_compact(F.array(quadrant, F.when(F.coalesce("jet", F.lit(False)), "jet_core"), F.lit("aggregate")))
    return joined.withColumn("class", F.explode(classes)).drop("ix", "iy", "jet")


def partition_labels(points: DataFrame, jet: DataFrame) -> DataFrame:
    """Five disjoint labels; JET comes before the quadrants."""
    ix, iy = cell_index(F.col("lon"), F.col("lat"))
    joined = points.withColumn("ix", ix).withColumn("iy", iy).join(jet, ["ix", "iy"], "left")
    west, south = F.col("lon") < BOX_LON + 5, F.col("lat") < BOX_LAT + 5
    label = F.when(F.coalesce("jet", F.lit(False)), "JET").when(south & west, "SW").when(south, "SE").when(west, "NW").otherwise("NE")
    return joined.withColumn("label", label).drop("ix", "iy", "jet")


def largest_component(mask: np.ndarray) -> np.ndarray:
    """Largest 4-connected part of a small mask, the first of equals."""
    label = np.zeros(mask.shape, int)
    for n, start in enumerate(map(tuple, np.argwhere(mask)), 1):
        todo = [start] if not label[start] else []
        while todo:
            i, j = todo.pop()
            if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not label[i, j]:
                label[i, j] = n
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    if not label.any():
        return np.zeros(mask.shape, bool)
    counts = np.bincount(label.ravel())
    counts[0] = 0
    return label == counts.argmax()


def proxy_cells(fields: DataFrame) -> DataFrame:
    """Per 2-degree cell: the mean over its nodes of each node's standard deviation in time."""
    nodes = fields.groupBy("node_id").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.stddev_pop("ssh").alias("sd"))
    ix, iy = cell_index(F.col("lon"), F.col("lat"))
    return nodes.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.avg("sd").alias("proxy"))


# Gauges.
CRITERIA = ("length", "completeness", "datum", "corrections", "distance")


def screen_gauges(gauges: DataFrame, ocean: DataFrame, least_days: int = 365, least_share: float = 0.7, most_km: float = 100.0) -> DataFrame:
    """A row for each gauge and criterion, in order, and whether the gauge passes them all.

    ``gauges``: gauge_id, lon, lat, days (array of dates), rlr_datum_ok, dac, tide. The ocean points
    are a mask's, joined by distance within the neighbouring degree cells.
    """
    span = F.datediff(F.array_max("days"), F.array_min("days")) + 1
    at = lambda c: F.floor(F.col(c)).cast("int")
    cells = gauges.select("gauge_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.explode(F.array(*[F.struct((at("lon") + i).alias("cx"), (at("lat") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select("gauge_id", "_lon", "_lat", "c.*")
    near = cells.join(ocean.select(F.col("lon").alias("_olon"), F.col("lat").alias("_olat"), at("lon").alias("cx"), at("lat").alias("cy")), ["cx", "cy"]).groupBy("gauge_id").agg(F.min(haversine_km(F.col("_lon"), F.col("_lat"), F.col("_olon"), F.col("_olat"))).alias("km"))
    tests = F.array(span >= least_days, F.size("days") >= least_share * span, F.col("rlr_datum_ok"), F.col("dac") & F.col("tide"), F.coalesce(F.col("km") <= most_km, F.lit(False)))
    rows = gauges.join(near, "gauge_id", "left").select("gauge_id", F.posexplode(tests).alias("position", "passed"))
    return rows.withColumn("criterion", F.element_at(F.array(*map(F.lit, CRITERIA)), F.col("position") + 1)).withColumn("gauge_passes", F.min("passed").over(W.partitionBy("gauge_id")))


def era_class(first: Column, last: Column) -> Column:
    """pre-2000, 2000-2010, post-2010, or full-span for a series that reaches over them."""
    y0, y1 = F.year(first), F.year(last)
    return F.when(y1 < 2000, "pre-2000").when((y0 >= 2000) & (y1 <= 2010), "2000-2010").when(y0 > 2010, "post-2010").otherwise("full-span")


def stratified_split(gauges: list[tuple[str, str, str]], seed: int, share: float = 0.3) -> dict[str, tuple[str, ...]]:
    """Held-out gauges of each basin and era: one generator over the strata in order."""
    rng, strata = np.random.default_rng(seed), {}
    for gauge, basin, era in sorted(gauges):
        strata.setdefault((basin, era), []).append(gauge)
    locked: list[str] = []
    for key in sorted(strata):
        own = strata[key]
        locked += [own[i] for i in sorted(rng.permutation(len(own))[: int(round(share * len(own)))])]
    return {"locked": tuple(locked), "open": tuple(g for g, _, _ in sorted(gauges) if g not in set(locked))}


# Missions and epochs.
def census(days: DataFrame, gap: int = 90) -> DataFrame:
    """Active intervals of each mission: runs of days without a gap of more than ``gap`` days."""
    w = W.partitionBy("mission").orderBy("day")
    fresh = F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap).cast("int"), F.lit(1))
    runs = days.dropDuplicates(["mission", "day"]).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("mission", "run").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("n_days"))


def epochs(intervals: list[tuple[str, dt.date, dt.date]], least_days: int = 365) -> list[tuple[dt.date, dt.date, frozenset[str]]]:
    """Half-open epochs between change dates; those below ``least_days`` join the neighbour with the
    more similar set of missions (Jaccard), the earlier one of two."""
    marks = sorted({d for _, a, b in intervals for d in (a, b + dt.timedelta(days=1))})
    rows = [(a, b, frozenset(m for m, s, e in intervals if s <= a and e >= b - dt.timedelta(days=1))) for a, b in pairwise(marks)]
    while len(rows) > 1:
        short = [(i, (b - a).days) for i, (a, b, _) in enumerate(rows) if (b - a).days < least_days]
        if not short:
            break
        i = min(short, key=lambda x: (x[1], x[0]))[0]
        alike = lambda j, i=i: len(rows[i][2] & rows[j][2]) / max(1, len(rows[i][2] | rows[j][2]))
        j = max((k for k in (i - 1, i + 1) if 0 <= k < len(rows)), key=lambda k: (alike(k), -k))
        a, b = sorted((i, j))
        longer = max((rows[a], rows[b]), key=lambda r: (r[1] - r[0]).days)
        rows[a : b + 1] = [(rows[a][0], rows[b][1], longer[2])]
    return rows


def epoch_table(spark: SparkSession, rows: list[tuple[dt.date, dt.date, frozenset[str]]]) -> DataFrame:
    """Registry row per epoch; the held-out mission is the last in order of names."""
    out = [(f"E{k:02d}", a, b, sorted(m), sorted(m)[-1] if m else None) for k, (a, b, m) in enumerate(rows)]
    return spark.createDataFrame(out, "epoch string, start date, stop date, missions array<string>, holdout string")


def window_epoch(windows: DataFrame, table: DataFrame) -> DataFrame:
    """The epoch that holds a window's centre; tens of epochs are the known small side."""
    e = table.select("epoch", "start", "stop")
    return windows.join(F.broadcast(e), (F.col("center") >= F.col("start")) & (F.col("center") < F.col("stop")), "left").drop("start", "stop")


def reference_candidates(table: DataFrame, locked: tuple[str, ...], least: int = 4) -> DataFrame:
    """Epochs with enough missions once the locked ones are taken away."""
    net = F.array_except("missions", F.array(*map(F.lit, locked)))
    return table.where(F.size(net) >= least).select("epoch", F.size(net).alias("n_net"))
