"""Session helpers: a local session for tests and benches, and shipping the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Bytes of an Arrow batch; texts differ so much in length that a number of rows bounds nothing.
BATCH, MOST_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once, unless their PYTHONPATH has it; bounds what a Python worker gets at a time."""
    sc = spark.sparkContext
    if int(re.sub(r"\D", "", spark.conf.get(BATCH, None) or "") or 1 << 40) > MOST_BATCH:
        spark.conf.set(BATCH, str(MOST_BATCH))
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lattix_shipped", False):
        return spark
    out = Path(tempfile.mkdtemp(prefix="spark-")) / "lattix.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(out))
    sc._lattix_shipped = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``; on one machine, a temporary one if unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def local(cpus: int | str = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session on this machine; on a cluster, submit with the cluster's own configuration."""
    n = partitions or (int(cpus) if str(cpus).isdigit() else 8)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lattix")
    base = {
        "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(n), "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "16m",
        "spark.sql.parquet.pushdown.inFilterThreshold": "100",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
