"""Session settings the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def get_session(app: str = "lodestone", cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session instead.

    UTC keeps timestamps comparable between engines, AQE re-plans skewed joins, and the
    shuffle-partition count is only the local default.
    """
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def widen(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores.

    Only a table of fewer file splits than cores is dealt anew (one row group is one task, whatever its work); a
    large table is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most some megabytes, whatever the rows' size, so that a Python worker's memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    It is the session's spark.checkpoint.dir. Only where that is unset and all runs on one machine
    (a local master, in tests) a temporary folder is made and kept in the session.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.shared.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share; the master is {master}")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("lodestone.shared.dir", place)
    return place.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package to executors that can't import it, once for each application."""
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    place = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    place.write_bytes(held.getvalue())
    sc.addPyFile(str(place))  # the driver serves it; executors fetch their own copy
    sc._lodestone_shipped = True
