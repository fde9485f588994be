"""What the operators share: the shared folder, written tables and small expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder (tests); on a
    cluster the setting is required, because a machine-local folder would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loamtext-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loamtext/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def n_written() -> int:
    """How many tables :func:`written` has made that are still there; a mark for :func:`remove_written`."""
    return len(_written)


def last_written() -> str:
    return _written[-1]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends here.

    A lost executor costs at most the tasks after this table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the tables that :func:`written` has made in this process, but the first ``since``
    and the one at ``keep``."""
    jvm = spark.sparkContext._jvm
    gone = [p for p in _written[since:] if p != keep]
    _written[since:] = [p for p in _written[since:] if p == keep]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        try:
            remove_written(spark)
        except Exception:  # the JVM may be gone already
            _written.clear()


atexit.register(_at_exit)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII texts take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())
    )


#: Rows and bytes of one Arrow batch on the way to Python; documents are long, and the batch,
#: its copy in the worker and what is made from it are held at once.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to the above if they are larger.

    They stay lowered: a plan reads them when it runs, which may be long after this call.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow`` in batches of bounded rows and bytes."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def carried(columns: list[str], *made: str) -> list[str]:
    """Names for carried columns beside new columns ``made``: a clashing one (in any case, as
    Spark compares names) gets ``_in`` behind it, until it is free."""
    new, taken, out = {m.lower() for m in made}, {c.lower() for c in (*columns, *made)}, []
    for c in columns:
        if c.lower() in new:
            while c.lower() in taken:
                c += "_in"
            taken.add(c.lower())
        out.append(c)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
