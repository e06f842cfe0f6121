"""Tables, and intermediate results that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests), a temporary folder of this machine
    serves; on a cluster an unset folder raises RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - a folder that is gone, or a session that has ended
        pass


def buckets_for(spark: SparkSession, rows: int, most: int = 4_000_000, least: int = 10_000) -> int:
    """How many buckets a table of ``rows`` rows gets: at most ``most`` rows in each, but no fewer
    than a shuffle has partitions, as Spark would else move the bucketed side; 0, none at all,
    where that leaves fewer than ``least`` rows in each and a shuffle costs less than the files."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, -(-rows // most)) if rows >= parts * least else 0


class Workspace:
    """Written intermediate tables of one computation.

    ``keep`` writes a DataFrame as Parquet into the shared folder and reads it back: that cuts
    the lineage of loops, survives lost executors, and gives the planner true sizes.  ``drop``
    deletes a table as soon as it is superseded; what is still there goes when Python ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex[:12]}"
        self.count, self.database = 0, self.root.rsplit("/", 1)[-1].replace("-", "_")
        self.tables = 0
        atexit.register(self.close)

    def close(self) -> None:
        """Delete all that is left: files, and the catalog's entries with their database."""
        try:
            if self.tables:
                self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        except Exception:  # noqa: BLE001 - the session may have ended, and its catalog with it
            pass
        _delete(self.spark, self.root)

    def keep(self, df: DataFrame, name: str = "t", bucket: str | None = None, buckets: int = 0, place: bool = False, ordered: bool = False, **options: str) -> DataFrame:
        """``df`` written and read back.  With ``buckets`` it becomes a table of so many buckets by
        the column ``bucket``, in a database of this workspace: a later join on the column needs no
        shuffle of it.  ``place`` first sends rows to their buckets' tasks, which a frame that is
        partitioned so needs not; ``ordered`` sorts each bucket by the column.  ``options`` are those
        of the writer."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}-{name}"
        if not buckets:
            df.write.options(**options).parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            if not self.tables:
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.root}/database'")
            self.tables += 1
            table_ = f"{self.database}.t{self.count:04d}"
            writer = (df.repartition(buckets, bucket) if place else df).write.format("parquet").option("path", path).bucketBy(buckets, bucket)
            (writer.sortBy(bucket) if ordered else writer).saveAsTable(table_)
            out = self.spark.table(table_)
            out._workspace_table = table_  # noqa: SLF001
        out._workspace_path = path  # noqa: SLF001
        return out

    def counted(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
        """``keep``, and the number of rows, seen while writing."""
        seen = Observation()
        return self.keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            table_, path = getattr(df, "_workspace_table", None), getattr(df, "_workspace_path", None)
            if table_:
                self.spark.sql(f"DROP TABLE IF EXISTS {table_}")
            if path:
                _delete(self.spark, path)
