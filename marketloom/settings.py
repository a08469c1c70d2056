"""Session settings and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Engine options the operators rely on; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording a call site per column expression slows plan building several times.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Apply the options that change results (time zone) to a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_own_dir: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder on the storage named by ``spark.checkpoint.dir``.

    Only where that setting is absent is a temporary folder made, one for each process, and
    only in local mode, where driver and tasks share the machine; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_dir.setdefault("root", "") or tempfile.mkdtemp(prefix="spark-marketloom-")
        _own_dir["root"] = root
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_shared(spark: SparkSession) -> int:
    """Delete the shared folders of this process, once no result that reads them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
