"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: White space of the contracts, as a character class body: blank, tab, LF, VT, FF, CR.
WHITE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in a local session without one, as in tests, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting can't be made in a running session, so the folder of each application is kept here
        base = _folders.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="tidewake-")
        if _folders.setdefault(spark.sparkContext.applicationId, base) == base and spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_folders: dict[str, str] = {}
#: What each session has stored, by its id.
_made: dict[str, list[str]] = {}
_scopes = threading.local()


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in (_made.setdefault(_session(spark), []), *getattr(_scopes, "open", [])):
        made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that operators of this session have stored so far, once results that read them are written; how many there were."""
    made = _made.pop(_session(spark), [])
    return sum(_delete(spark, path) for path in made)


@contextmanager
def passing(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Within it, tables are stored as ever; at its end those whose names are not in kept are deleted, so what is returned may read only the kept ones."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
    for path in made:
        if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in kept:
            _delete(spark, path)
            own = _made.get(_session(spark), [])
            if path in own:
                own.remove(path)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds in a Python worker, by rows and by bytes, and let workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_name(df: DataFrame, name: str) -> str:
    """name, if no column of df has it (in any case of letters); an operator never overwrites or doubles a column of its input."""
    if any(c.lower() == name.lower() for c in df.columns):
        raise ValueError(f"the input has a column {name}, the name of this operator's result; rename it first")
    return name


def whole_id(df: DataFrame, name: str) -> Column:
    """An id as a long; null where it is no whole number, so that no two ids become one."""
    col, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return col.cast("long")
    if kind == "string":
        return F.when(col.rlike(r"^\s*[+-]?[0-9]+\s*$"), col.try_cast("long"))
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.when(col == F.floor(col), col.try_cast("long"))
    return F.lit(None).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: str = "doc_id"):
    return F.col(col).cast("string")
