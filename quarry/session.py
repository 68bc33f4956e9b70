"""SparkSession construction and cluster-safe helpers.

Everything here is ordinary session configuration: AQE on (runtime
coalescing, skew-join splitting, broadcast conversion from measured
sizes), UTC session time zone, no UI. Checkpoints go to the shared folder
named by ``spark.checkpoint.dir``; only when the session has none (tests,
local runs) do we pick a scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # transformWithState operators need the RocksDB state store
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# State store for transformWithState operators.
ROCKSDB_CONF = {"spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    master = master or os.environ.get("QUARRY_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.driver.memory"] = os.environ.get("QUARRY_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


# Bytes of an Arrow batch: rows may be whole pages, so a bound on rows alone does not bound a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    current = spark.conf.get(name)
    if not current.isdigit() or not 0 < int(current) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker (``addPyFile`` of a
    zip of the package), once per application. UDFs defined in the package
    are pickled by reference and need it on the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-pyfiles-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "quarry"), "zip", os.path.dirname(pkg_dir), "quarry")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is. Local runs and tests get a fresh ``mktemp`` folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


# Codec of stored tables: texts that overlap and repeated words take a third of what snappy leaves of them.
CODEC = "zstd"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read back: they
    survive executor loss, are not computed again (an eager checkpoint computes
    them twice), and their size is known to the planner."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
