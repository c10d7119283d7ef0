"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node, so that a vector held by many rows costs what one row costs. The graph
begins with exact neighbours inside chunks of random-hyperplane buckets; each round then joins the
neighbours of a node, new ones with all, forward and (sampled) reverse ones, and keeps what is
nearer than a node's present neighbours, until few edges change. All of it is joins and group-bys
of Spark; a task holds one node's lists at a time.

Between tables vectors travel as they are, in 4 or 8 bytes a component by the column's type, and
candidates are ordered by them. The whole beam of a query is measured again at the end, in double
precision and without the clipping of components beyond 1e30.

The search keeps a beam per query and expands its nearest nodes that weren't expanded yet, for all
queries at once, until every beam is done. A query that is in the index begins at its own node, so
that it doesn't depend on paths into its part of the graph, and every query at the nearest of a
sample of entries that grows with the square root of the index. Adjacency rows hold ids and are
bucketed by node; a round joins the vectors of those neighbours that a beam doesn't hold yet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import FILE_BYTES, Workspace, arrow_batches, partitions

#: Neighbours per node, those of one kind joined in a round, rounds, share of changed edges at which they end.
DEGREE, SAMPLE, ROUNDS, SETTLED = 24, 14, 6, 0.03
#: Random-hyperplane tables and chunk size of the first graph.
TABLES, CHUNK = 3, 64
#: Beam, and nodes that a query expands in a round.
BEAM, EXPAND = 384, 64
#: Least and most nodes in the sample that searches start from (4 sqrt(n) between), and nodes of it that a query takes.
ENTRIES, MOST_ENTRIES, STARTS = 512, 1 << 16, 24
#: Buckets of the adjacency table at most (Spark allows 100,000); beyond, its files grow.
MOST_FILES = 8192
_SEED = 20240


def usable(column: Column) -> Column:
    """Vectors that take part: without nulls or non-finite components, and not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0)


def unpack(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw).view(kind).astype(np.float64)


def _packed(column: pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1) if parts else np.zeros((0, 8), np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    if len(a):  # near copies of one vector differ by little of their length
        a, b = a - a[0], b - a[0]
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _edges(v: np.ndarray, u: np.ndarray, d: np.ndarray, degree: int) -> pa.RecordBatch:
    """Each v's ``degree`` nearest u of those given, each once."""
    order = np.lexsort((u, d, v))
    v, u, d = v[order], u[order], d[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (d[1:] != d[:-1])
    v, u, d = v[first], u[first], d[first]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    rank = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
    keep = rank < degree
    return pa.RecordBatch.from_arrays([pa.array(v[keep], pa.int64()), pa.array(u[keep], pa.int64()), pa.array(d[keep].astype(np.float32))], names=["v", "u", "d"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from rows that come sorted by key."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
        keys = rest[key].to_numpy()
        new = np.flatnonzero(keys[1:] != keys[:-1])
        if len(new):
            cut = int(new[-1]) + 1
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


class Graph:
    """Nodes (id, vector, packed, members) and edges of a neighbour graph."""

    def __init__(self, vectors: DataFrame, work: Workspace, members: int, degree: int = DEGREE, rounds: int = ROUNDS) -> None:
        self.spark, self.work, self.degree = vectors.sparkSession, work, degree
        arrow_batches(self.spark)
        self.kind = kind = np.float32 if isinstance(vectors.schema["vector"].dataType.elementType, FloatType) else np.float64
        sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.dimension = sizes["n"] if sizes else 1
        rows = vectors.where(F.size("vector") == self.dimension).select("id", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["id", "vector"])
        # Of rows with equal vectors the smallest ids: the limit on ranks applies before the shuffle.
        rank = F.row_number().over(W.partitionBy("vector").orderBy("id"))
        few = rows.withColumn("_r", rank).where(F.col("_r") <= members)
        nodes = few.groupBy("vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members"))
        self.nodes = work.save(nodes.select("id", "vector", "members").mapInArrow(_pack_rows(kind), "id long, vector array<double>, members array<long>, packed binary"), "nodes", 10 * self.dimension * rows.count())
        self.n = self.nodes.count()
        self.edges = self._descend(self._first(), rounds)

    def _first(self) -> DataFrame:
        """Neighbours inside chunks of buckets of random hyperplanes."""
        bits, dimension, degree, kind = max(0, int(np.log2(max(self.n / CHUNK, 1)))), self.dimension, self.degree, self.kind

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng(_SEED).standard_normal((TABLES, max(bits, 1), dimension)).astype(np.float32)
            for batch in batches:
                x = unpack(_packed(batch.column(1)), kind)
                for t in range(TABLES):
                    key = ((x @ planes[t].T > 0) @ (1 << np.arange(max(bits, 1)))) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64) * TABLES + t), batch.column(0), batch.column(1)], names=["bucket", "id", "packed"])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _runs(batches, "bucket"):
                ids, x = part["id"].to_numpy(), unpack(_packed(part["packed"].combine_chunks()), kind)
                for lo in range(0, len(ids), CHUNK):  # in another order in each table, so that chunks of one bucket connect
                    own, y = ids[lo : lo + CHUNK], x[lo : lo + CHUNK]
                    d = distances(y, y)
                    i, j = np.nonzero(~np.eye(len(own), dtype=bool))
                    yield _edges(own[i], own[j], d[i, j], degree)

        spread = self.nodes.select("id", "packed").mapInArrow(placed, "bucket long, id long, packed binary")
        return spread.repartition(partitions(self.spark), "bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, self.n // 50_000)))).sortWithinPartitions("bucket", F.xxhash64("id", "bucket")).mapInArrow(near, "v long, u long, d float")

    def _merge(self, edges: DataFrame) -> DataFrame:
        """Nearest ``degree`` edges of each node; an edge is new if no source holds it as old."""
        once = edges.groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        return once.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("d", "u"))).where(F.col("_r") <= self.degree).drop("_r")

    def _descend(self, first: DataFrame, rounds: int) -> DataFrame:
        work, degree, kind, nbytes = self.work, self.degree, self.kind, 24 * self.degree * self.n
        now = work.save(self._merge(first.withColumn("new", F.lit(1))), "edges-0", nbytes)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            n = 0

            def flush() -> pa.RecordBatch:
                return _edges(*(np.concatenate(c) for c in zip(*held, strict=True)), degree)

            for part in _runs(batches, "v"):
                v, u, fresh, bar = (part[c].to_numpy() for c in ("v", "u", "fresh", "bar"))
                x = unpack(_packed(part["packed"].combine_chunks()), kind)
                at = np.append(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), len(v))
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    isnew = np.flatnonzero(fresh[lo:hi] == 1)
                    if not len(isnew) or hi - lo < 2:
                        continue
                    d = distances(x[lo:hi][isnew], x[lo:hi])
                    i, j = np.nonzero(d < np.maximum(bar[lo:hi][isnew][:, None], bar[lo:hi][None, :]))
                    a, b, d = u[lo:hi][isnew][i], u[lo:hi][j], d[i, j]
                    ba, bb = bar[lo:hi][isnew][i], bar[lo:hi][j]
                    other = a != b
                    for s, t, most in ((a, b, ba), (b, a, bb)):
                        good = other & (d < most)
                        held.append((s[good], t[good], d[good]))
                        n += int(good.sum())
                    if n > 400_000:
                        yield flush()
                        held, n = [], 0
            if held:
                yield flush()

        for k in range(1, rounds + 1):
            order = F.xxhash64("v", "u", F.lit(k))
            ranked = now.withColumn("_r", F.row_number().over(W.partitionBy("v", "new").orderBy(order)))
            used = work.save(ranked.where(F.col("_r") <= SAMPLE).select("v", "u", "new"), "used", nbytes)
            back = used.select(F.col("u").alias("v"), F.col("v").alias("u"), "new").withColumn("_r", F.row_number().over(W.partitionBy("v", "new").orderBy(F.xxhash64("v", "u", F.lit(k))))).where(F.col("_r") <= SAMPLE).drop("_r")
            lists = used.unionByName(back).groupBy("v", "u").agg(F.max("new").alias("fresh"))
            bars = now.groupBy("v").agg(F.when(F.count(F.lit(1)) >= degree, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("bar"))
            ends = self.nodes.select(F.col("id").alias("u"), "packed").join(bars.withColumnRenamed("v", "u"), "u", "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf")).cast("float")))
            joined = lists.join(ends, "u").select("v", "u", "fresh", "bar", "packed")
            found = joined.repartition(partitions(self.spark), "v").sortWithinPartitions("v").mapInArrow(local, "v long, u long, d float")
            kept = now.join(used.where("new = 1").select("v", "u", F.lit(1).alias("_used")), ["v", "u"], "left").select("v", "u", "d", F.when(F.col("_used").isNotNull(), 0).otherwise(F.col("new")).alias("new"))
            after = work.save(self._merge(kept.unionByName(found.withColumn("new", F.lit(1)))), f"edges-{k}", nbytes)
            changed = after.join(now.select("v", "u"), ["v", "u"], "left_anti").count()
            work.drop(f"edges-{k - 1}", "used")
            now = after
            if changed <= SETTLED * self.n * degree:
                break
        return now

    def adjacency(self) -> str:
        """Name of a bucketed table (node, near): neighbours of both directions, reverse ones limited. Ids alone:
        vectors are stored once, with the nodes."""
        back = self.edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "d").withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("d", "u"))).where(F.col("_r") <= self.degree)
        both = self.edges.select("v", "u").unionByName(back.select("v", "u"))
        grouped = both.groupBy(F.col("v").alias("node")).agg(F.collect_set("u").alias("near"))
        name = f"sk_adjacency_{uuid.uuid4().hex}"
        files = int(min(max(2 * self.spark.sparkContext.defaultParallelism, -(-self.n * self.degree * 16 // FILE_BYTES)), MOST_FILES))
        grouped.repartition(files, "node").write.bucketBy(files, "node").format("parquet").saveAsTable(name)
        return name


def _pack_rows(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy()
            x = flat.reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, 1))
            # Components beyond 1e30 keep their direction.
            yield pa.RecordBatch.from_arrays([batch.column(0), column, batch.column(2), _binary(np.clip(x, -1e30, 1e30).astype(kind))], names=["id", "vector", "members", "packed"])

    return run


def entry_count(n: int) -> int:
    return min(max(ENTRIES, int(4 * n**0.5)), MOST_ENTRIES)


def search(graph: Graph, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query, id, score, rank): the k nearest found for each row (query, vector) of ``queries``.

    A row of the index with the id of the query is not a candidate of it.
    """
    spark, work, kind = graph.spark, graph.work, graph.kind
    rows = queries.where(F.size("vector") == graph.dimension).select(F.col("query"), F.col("vector").cast("array<double>").alias("vector"), F.array().cast("array<long>")).dropDuplicates(["query"])
    asked = work.save(rows.mapInArrow(_pack_rows(kind), "query long, vector array<double>, members array<long>, packed binary").drop("members"), "queries", graph.n * graph.dimension)
    sample = graph.nodes.orderBy(F.xxhash64("id", F.lit(_SEED)), "id").limit(entry_count(graph.n)).select("id", "packed").collect()  # bounded by MOST_ENTRIES
    entries = spark.sparkContext.broadcast(([r["id"] for r in sample], b"".join(bytes(r["packed"]) for r in sample)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = entries.value
        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            y = unpack(np.frombuffer(raw, np.uint8).reshape(len(ids), -1), kind)
            x = np.clip(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), -1e30, 1e30)
            d = distances(x, y)
            best = np.argsort(d, axis=1, kind="stable")[:, :STARTS]
            query = np.repeat(batch.column(0).to_numpy(), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.array(ids, np.int64)[best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel().astype(np.float32)), pa.array(np.zeros(len(query), np.int32))], names=["query", "node", "d", "done"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances of (query, node, packed query, packed node, bar), those up to the bar."""
        for batch in batches:
            d = ((unpack(_packed(batch.column(2)), kind) - unpack(_packed(batch.column(3)), kind)) ** 2).sum(1).astype(np.float32)
            near = pa.array(d <= batch.column(4).to_numpy())
            own = [batch.column(k).filter(near) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(d).filter(near), pa.array(np.zeros(len(own[0]), np.int32))], names=["query", "node", "d", "done"])

    nbytes = 24 * beam * asked.count()
    own = asked.join(graph.nodes.select(F.col("id").alias("node"), "vector"), "vector").select("query", "node", F.lit(0.0).cast("float").alias("d"), F.lit(0).alias("done"))
    first = asked.mapInArrow(begin, "query long, node long, d float, done int").unionByName(own).groupBy("query", "node").agg(F.min("d").alias("d"), F.min("done").alias("done"))
    now = work.save(first, "beam-0", nbytes)
    name = graph.adjacency()
    try:
        now = _walked(now, asked, graph, name, work, beam, measure, nbytes)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    best = now.select("query", "node")
    exact = best.join(asked.withColumnRenamed("vector", "_x"), "query").join(graph.nodes.select(F.col("id").alias("node"), F.col("vector").alias("_y"), "members"), "node")
    score = F.sqrt(F.aggregate(F.zip_with("_x", "_y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = exact.select("query", score.alias("score"), F.explode("members").alias("id")).where("id <> query")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("score", "id"))).where(F.col("rank") <= k)
    return work.save(rows.select("query", "id", "score", F.col("rank").cast("int").alias("rank")), "results", nbytes)


def _walked(now: DataFrame, asked: DataFrame, graph: Graph, name: str, work: Workspace, beam: int, measure: Callable, nbytes: float) -> DataFrame:
    """The beams once nothing in them is left to expand; a round expands something in every open one."""
    spark, k_round = asked.sparkSession, 0
    ordered = W.partitionBy("query").orderBy("d", "node")
    vectors = graph.nodes.select(F.col("id").alias("node"), "packed")
    while True:
        k_round += 1
        frontier = now.where("done = 0").withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= EXPAND).select("query", "node")
        frontier = work.save(frontier, f"frontier-{k_round}", nbytes)
        if not frontier.limit(1).count():
            return now
        # Neighbours that the beam doesn't hold, each once; what is beyond the last of a full beam would only be dropped again.
        seen = frontier.join(spark.table(name), "node").select("query", F.explode("near").alias("node")).distinct().join(now.select("query", "node"), ["query", "node"], "left_anti")
        bars = now.groupBy("query").agg(F.when(F.count(F.lit(1)) >= beam, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("bar"))
        given = seen.join(vectors, "node").join(asked.select("query", F.col("packed").alias("_own")).join(bars, "query"), "query").select("query", "node", "_own", "packed", "bar")
        found = given.mapInArrow(measure, "query long, node long, d float, done int")
        expanded = frontier.withColumn("d", F.lit(float("inf")).cast("float")).withColumn("done", F.lit(1)).select("query", "node", "d", "done")
        union = now.unionByName(found).unionByName(expanded).groupBy("query", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        after = work.save(union.withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= beam).drop("_r"), f"beam-{k_round}", nbytes)
        work.drop(f"beam-{k_round - 1}", f"frontier-{k_round}")
        now = after


def neighbours(vectors: DataFrame, work: Workspace, every: int, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row of ``vectors`` whose
    vec_id is divisible by ``every``, by Euclidean distance, ties to the smaller vec_id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without a vec_id or with another number of components than most rows have. Repeated rows count
    once; other columns are not read. Without candidates there are no rows.
    """
    usable_rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    graph = Graph(usable_rows, work, members=k + 1)
    queries = usable_rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "vector")
    return search(graph, queries, k, beam).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
