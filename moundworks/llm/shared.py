"""What the operators of this subpackage share: the shared folder and staged tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` where the cluster
    names one, else the context's own checkpoint folder; only where neither is set and the master is
    local (tests on one machine) a temporary folder is made and set, elsewhere that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        now = sc._jsc.sc().getCheckpointDir()
        named = now.get() if now.isDefined() else None
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="moundworks-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder (not created). What is written there serves frames
    of this process, so it is removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _at_exit()
    _made.append(path)
    return path


def fresh_table(name: str) -> str:
    """A new name for a table of the session's catalog, which loses it when the process ends."""
    table = f"moundworks_{name}_{uuid.uuid4().hex}"
    _at_exit()
    _tables.append(table)
    return table


def _at_exit() -> None:
    if not _made and not _tables:
        atexit.register(clean)


_made: list[str] = []
_tables: list[str] = []


def clean() -> None:
    """Remove the tables and folders that this process had written, as far as they can be reached."""
    spark = SparkSession.getActiveSession()
    while _tables:
        name = _tables.pop()  # before anything can fail: the loop must end without a session too
        with contextlib.suppress(Exception):
            if spark is not None:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _made:
        path = _made.pop()
        with contextlib.suppress(Exception):  # the process ends; what stays is only space
            if urlparse(path).scheme in ("", "file"):
                shutil.rmtree(urlparse(path).path)
            elif spark is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs
    no recomputation of what stands before."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application: their Python workers need not have
    it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="moundworks-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, each: Column | None = None) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them without a scan; it sizes the
    tasks of what follows. Where the planner has no figure, the rows are read and ``each`` of them
    (default: the length of its text) summed."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if n < 1 << 55:
        return n
    return df.agg(F.sum(F.octet_length("text") if each is None else each).alias("n")).first()["n"] or 0


#: Of a shuffle: beyond it each task's share grows, and is sorted on disk.
MOST_PARTS = 20_000


def parts(spark: SparkSession, size: int, each: int, most: int | None = MOST_PARTS) -> int:
    """How many tasks so that each gets about ``each`` bytes, but no more than ``most`` (None: no
    bound) and no fewer than the session's number of shuffle partitions."""
    n = max(-(-size // each), 1)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n if most is None else min(n, most))
