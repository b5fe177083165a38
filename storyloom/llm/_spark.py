"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tells the rows of a table apart, whatever their own ids are.
ROW = "_row"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a local master (tests, a laptop) may go without that
    setting; there a temporary folder is set, since driver and tasks are one machine.
    """
    found = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    This cuts the lineage at a stable copy: a lost executor costs its tasks only, and later passes do not
    recompute what stands before. Like checkpoint files, the copies stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Holds all columns of a row while an operator adds its own, so that names never clash.
WHOLE = "_whole"


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct named ``WHOLE``."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias(WHOLE)


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """(ROW, WHOLE) of each row of ``df``: a unique id and all columns, written so that the ids stay as they are."""
    return written(df.select(F.monotonically_increasing_id().alias(ROW), whole(df)), name)


def placed_rows(df: DataFrame, name: str) -> DataFrame:
    """(ROW, WHOLE) of each row of ``df``, as ``with_rows``; but a table that is nothing but a scan of files is numbered by the places of its rows and not copied.

    Spark deals the same files to the same partitions in the same order whenever it reads them with the same settings, so each pass over the table gives each row the same number.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project" and node.children().size() == 1 and node.deterministic():
        node = node.children().apply(0)
    if node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation"):
        return df.select(F.monotonically_increasing_id().alias(ROW), whole(df))
    return with_rows(df, name)


class Scratch:
    """Tables that one operator writes on its way and deletes when its result stands."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def close(self) -> None:
        discard(*self.tables)
        self.tables = []


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more. Empty tables have no files and may stay."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that ``edges`` (a, b) reach from each id that they name.

    Alternates large-star and small-star steps until the edge set stays as it is. Each step aggregates with a
    map-side minimum and joins edges with one row per id, so a hub with very many edges is never gathered in
    one place and Spark may split it in the join.
    """
    now = written(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "edges"
    )
    state = None
    while True:
        both = now.union(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u move to the least id around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: u and its smaller neighbours move to the least of them
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small_least, "hi")
        small = (
            joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(joined.select("hi", F.col("m").alias("lo")))
            .where("hi <> lo")
            .distinct()
            .select("lo", "hi")
        )
        before, now = now, written(small, "edges")
        discard(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = tuple(found)
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        now.select("lo", "lo").distinct().toDF("id", "component")
    )
