"""What every operator needs from the session: executors that can import this package, and a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application (what ``--py-files`` does)."""
    context = spark.sparkContext
    if getattr(context, "_linkweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="linkweave-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._linkweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets one of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_linkweave_folder", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._linkweave_folder = folder
    return folder


def _folders(spark: SparkSession) -> list[str]:
    """Where tables go: the application's folder, and those of the ``scratch`` blocks that are open."""
    context = spark.sparkContext
    if not hasattr(context, "_linkweave_folders"):
        context._linkweave_folders = [f"{shared_folder(spark)}/linkweave-{context.applicationId}"]
    return context._linkweave_folders


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end: what is read of them has to be written elsewhere by then."""
    folders = _folders(spark)
    folders.append(f"{folders[0]}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, folders.pop())


#: Bytes of an Arrow batch, which is held on both sides of a Python worker, while a table is materialised.
ARROW_BYTES = 8 << 20


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for what is run inside; the caller's own is put back."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark)
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkweave_path = path
    return out


def new_path(spark: SparkSession) -> str:
    """A path for a table; taken before a ``scratch`` block, the table outlives the block."""
    return f"{_folders(spark)[-1]}/{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` gave, when nothing will read it again."""
    _delete(df.sparkSession, df._linkweave_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column has it, without regard to case: for columns that exist only in between."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, run, ddl: str) -> DataFrame:
    """``df.mapInArrow``: ``run`` gives the columns it got and those of ``ddl`` after them. Any column names and types will do."""
    # mapInArrow looks its columns up by name, where a point means a field
    pointed = [c for c in df.columns if "." in c]
    other = dict(zip(pointed, unused(df, *(f"column_{c.replace('.', '_')}" for c in pointed)), strict=True))
    inner = [other.get(c, c) for c in df.columns]
    new = T.StructType.fromDDL(ddl)
    fields = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(inner, df.schema.fields, strict=True)]
    return df.toDF(*inner).mapInArrow(run, T.StructType([*fields, *new.fields])).toDF(*df.columns, *new.names)
