"""Tables in the folder that driver and executors share; this package on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast at most; beyond it a join by shuffle is used.
BROADCAST_BYTES = 32 << 20

#: Rows and bytes of a batch that Python workers get; texts can be long. One text longer than that is a batch of its own.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20

_shipped: set[str] = set()
_own_root: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset, a folder of our own, if all executors are on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    return _own_root[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """Where a table may be written in the shared folder; sweep() deletes it."""
    path = f"{scratch_root(spark)}/scriptorium-{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, with a folder for each value of `by`, and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more."""
    for t in tables:
        _written[t.sparkSession.sparkContext.applicationId].remove(t._scriptorium_path)
        _delete(t.sparkSession, t._scriptorium_path)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this application materialised. Only once what reads them has been stored."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def by_checked_size(small: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """A broadcast hint only where the counted rows, of `width` bytes at most, are within the bound; else the join shuffles."""
    return F.broadcast(small) if rows * width <= BROADCAST_BYTES else small


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, and bound Arrow batches of whole texts in rows and bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    if not top.is_dir():  # imported from an archive: executors have it already
        return
    to = os.path.join(tempfile.mkdtemp(prefix="scriptorium-ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(to)
