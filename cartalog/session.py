"""Session helpers: sessions for tests and bench, tables, lineage cuts, checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have at most to be sent to every executor.
BROADCAST_ROWS = 200_000


def local_session(app: str = "cartalog", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A session on this machine, for tests and bench."""
    return ship(
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("CARTALOG_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_cartalog_shipped", False):
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        # Only the driver reads this file; executors fetch it from there.
        target = Path(tempfile.mkdtemp(prefix="cartalog-package-")) / "cartalog-package.zip"
        target.write_bytes(packed.getvalue())
        context.addPyFile(str(target))
        context._cartalog_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: lineage ends, lost executors do no harm.

    The folder is the session's ``spark.checkpoint.dir``. Only a session on this machine, as in tests, may leave it unset and gets a local one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cartalog-checkpoint-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows. Looks no further than one row beyond."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it, else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, most) else df

