"""Written tables in the shared folder, used to cut lineage.

A table written here is read back by every later stage, so a lost executor costs a re-read and
never a recomputation that could choose other range bounds or another row order.
"""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: By application, the folder of a local session that names none.
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="corpusmix-")
    return path.rstrip("/")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _remember(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))


def ship(spark: SparkSession) -> None:
    """Put the package's modules into the shared folder and name them to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmix_shipped", False):
        return
    home = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(home.parent))
    path = f"{shared_dir(spark)}/corpusmix-{uuid.uuid4().hex}.zip"
    p, fs = _files(spark, path)
    out = fs.create(p)
    out.write(bytearray(data.getvalue()))
    out.close()
    _remember(spark, path)
    sc.addPyFile(path)
    sc._corpusmix_shipped = True


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where the files they come from make fewer splits than there are cores.

    Only a table of so few files and row groups is dealt out; a larger one keeps its splits and isn't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back.

    An empty df gives an empty table of the same schema. Files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _remember(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmix_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a table of materialize that nothing reads any more."""
    spark, path = df.sparkSession, df._corpusmix_path
    p, fs = _files(spark, path)
    fs.delete(p, True)
    _written.remove((spark, path))


def publish(df: DataFrame, path: str) -> bool:
    """Write df as the parquet folder path, whole or not at all; False where the folder is there already.

    The table is written beside it and renamed, so a run that is lost leaves nothing that counts, and of two runs one wins.
    """
    spark = df.sparkSession
    p, fs = _files(spark, path)
    if fs.exists(p):
        return False
    half, _ = _files(spark, f"{p.getParent().toString()}/_half-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(half.toString())
    won = not fs.exists(p) and fs.rename(half, p)
    if not won:
        fs.delete(half, True)
    return won


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders within a folder; none where it isn't there."""
    p, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def _sweep() -> None:
    for spark, path in _written:
        try:
            p, fs = _files(spark, path)
            fs.delete(p, True)
        except Exception:  # the session is gone
            return
