"""Session helpers: settings, table access, the package on the executors, and tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, **settings: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("drafthorse")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that go to a Python worker at once: texts are long, and ten thousand of them would be held on either side.
BATCH_ROWS = 2000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once an application: the driver may have it on its own path alone.

    Where the session leaves the size of Arrow batches at Spark's default, it becomes BATCH_ROWS.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    own = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="drafthorse-code-")  # the driver's own: Spark serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "drafthorse_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(own):
            for n in sorted(names):
                if n.endswith(".py"):
                    file = os.path.join(top, n)
                    z.write(file, os.path.relpath(file, os.path.dirname(own)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="drafthorse-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    """(file system, path) on the JVM side."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_claimed: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new path in the application's part of the shared folder; that part goes when the driver ends."""
    folder = f"{shared_dir(spark)}/drafthorse/{spark.sparkContext.applicationId}"
    if folder not in _claimed:
        fs, at = _files(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _claimed.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and the copy outlives lost executors.

    The table goes when the driver ends; discard() deletes it before.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._drafthorse_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for t in tables:
        fs, at = _files(t.sparkSession, t._drafthorse_path)
        fs.delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
