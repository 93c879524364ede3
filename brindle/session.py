"""Session set-up and the tables that cut a long lineage."""

from __future__ import annotations

import importlib.util
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ = "spark.sql.parquet.columnarReaderBatchSize"


def get_spark(cpus: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brindle")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever they run. Once a context.

    Batches, Arrow's and those of the Parquet reader, hold whole texts or long lists, so they get few rows, unless the session
    was started with a number of its own.
    """
    sc = spark.sparkContext
    for name, usual in ((ROWS, "10000"), (READ, "4096")):
        if not sc.getConf().contains(name) and spark.conf.get(name, usual) == usual:
            spark.conf.set(name, "500")
    if getattr(sc, "_brindle_shipped", False):
        return
    root = os.path.dirname(importlib.util.find_spec("brindle").origin)
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._brindle_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _root(spark: SparkSession) -> str:
    """The folder of this application's tables; it goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/brindle-{sc.applicationId}"
    if getattr(sc, "_brindle_root", None) != root:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._brindle_root = root
    return root


def clean(spark: SparkSession) -> None:
    """Delete all tables that operators of this application have written. Results not yet written elsewhere go with them."""
    _delete(spark, _root(spark))
    spark.sparkContext._brindle_root = None


class Staged:
    """Tables written between the steps of one operator, so that a lost executor costs one step and plans stay short.

    A result is lazy and may read such tables, so they stay until `drop`, `clean`, the end of the application, or the end of a
    with-block: `with Staged(spark) as s: near_duplicates(docs, staged=s).write...`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{_root(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[str, DataFrame]] = {}  # the table is held, so that its id stays its own

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, self.root)
        self._paths.clear()

    def write(self, df: DataFrame) -> DataFrame:
        """df as a table of the shared folder, read again."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path, out
        return out

    def counted(self, df: DataFrame, *more: Column) -> tuple:
        """The written table, its number of rows and more aggregates, taken along with the writing."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(f"more_{k}") for k, c in enumerate(more))))
        return out, seen.get["n"], *(seen.get[f"more_{k}"] for k in range(len(more)))

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            if t is not None and (found := self._paths.pop(id(t), None)):
                _delete(self.spark, found[0])

    def keep(self, *tables: DataFrame | None) -> None:
        """Delete all tables but these, which the result reads."""
        held = {id(t) for t in tables}
        for k in [k for k in self._paths if k not in held]:
            _delete(self.spark, self._paths.pop(k)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for heavy work on rows of one small file. No change for more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
