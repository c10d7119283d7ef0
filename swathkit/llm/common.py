"""Shared folder, saved intermediate tables, and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Aimed size of the files of a saved table.
FILE_BYTES = 32 << 20
#: Words of a text: runs of characters other than these white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (tests, local mode) is a local folder chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """Tables written under the shared folder; they cut lineage and survive lost executors.

    Results are read from some of them, so they stay until ``close``, which whoever has used up the
    result may call; operators drop what nothing reads any more themselves.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, nbytes: float | None = None) -> DataFrame:
        """Write and read again. Where the table's size is known to be about ``nbytes``, shuffle
        partitions are written together into files of ``FILE_BYTES``, at least two for each core."""
        out = f"{self.path}/{name}"
        if nbytes is not None:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-int(nbytes) // FILE_BYTES)))
        df.write.mode("overwrite").parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark drop unreachable shuffle files."""
        for name in names:
            self._delete(f"{self.path}/{name}")
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Delete everything; results that read from here can't be read again."""
        self._delete(self.path)


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_key(text: Column) -> Column:
    """64 bits that tell texts of one doc_id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(7))


def carried(df: DataFrame, *without: str) -> Column:
    """All columns of a row in one struct, ``_row``, so that no name can clash on the way."""
    return F.struct(*[named(c) for c in df.columns if c not in without]).alias("_row")


def restored(rows: DataFrame, columns: list[str], **new: Column | None) -> DataFrame:
    """The columns of ``_row`` again, those in ``new`` with another value."""
    return rows.select(*[(new[c] if new.get(c) is not None else F.col("_row").getField(c)).alias(c) for c in columns])


#: What one Arrow batch to a Python worker holds, the same for all operators: whichever query was built
#: last sets nothing else. A longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound batches by bytes, and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an undirected edge list.

    Alternating large-star and small-star rounds; every round is a group-by minimum, combined
    before the shuffle, so that a hub costs no more than its rows. Rounds end when the edge set
    is a set of stars; ``rounds`` is a guard that raises instead of giving a partial result.
    """
    nbytes = 32 * edges.count()
    now = work.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges-0", nbytes)
    last = None
    for k in range(1, rounds + 1):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        new = work.save(small, f"edges-{k}", nbytes)
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"edges-{k - 1}")
        now = new
        if mark == last:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return work.save(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()), "roots", nbytes)
        last = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
