"""Session defaults and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale.  Shuffle partitions are left to the caller
# (a cluster sets its own); AQE re-plans joins and coalesces small partitions
# at run time and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast by measured shuffle size only: the static estimate of an exploded or
    # aggregated side is not a size
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tagweave") -> SparkSession:
    """A local session for tests and the bench (no UI, AQE on)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", os.environ.get("TAGWEAVE_DRIVER_MEM", "8g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir``, or the
    session's checkpoint folder.  A machine-local one is made only for a
    local master (tests, one machine); a cluster must name a shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagweave-stages-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table under ``folder`` (default: the shared stage
    folder) and read it back: computed once for all its readers, the lineage
    cut, and safe when executors are lost (unlike a local checkpoint)."""
    path = f"{(folder or stage_root(df.sparkSession)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
