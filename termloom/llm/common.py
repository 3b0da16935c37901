"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import remove, shuffles_end

#: The ASCII white space that separates words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Folders that :func:`stored` has written, in order.
STORED: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(text: str | None) -> bytes:
    """A text as UTF-8; null is empty, lone surrogates (never in Parquet) become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it; a temporary one only where all is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def ship(spark: SparkSession) -> None:
    """Gives the package to executors, which may have no copy of it: once for each context."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_termloom", None) is None and package.is_dir():
        sc._termloom = tempfile.mkdtemp(prefix="termloom-")
        with zipfile.ZipFile(f"{sc._termloom}/termloom.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(f"{sc._termloom}/termloom.zip")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: it cuts the
    lineage, survives lost executors, and gives later joins a known size.  The shuffles
    that led to it end with the write."""
    path = f"{shared_dir(df.sparkSession)}/termloom/{uuid.uuid4().hex}"
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    STORED.append(path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._stored_at)


def stored_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; tables that were stored on the way to it are deleted."""
    at = len(STORED)
    out = stored(make())
    for path in STORED[at:-1]:
        remove(out.sparkSession, path)
    del STORED[at:]
    return out


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, spread: list[str], by: list[str] | None = None, ways: int = 64, total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of left with stored right, whose column ``n`` counts the rows of left that
    have its key (in each of its rows, of which a key may have several).  A key with more than a thousandth of all those rows (there are less than
    a thousand such) is split ``ways`` ways by the columns ``spread`` of left.  ``by``:
    columns of the key that tell hot keys well enough, if others are large.  ``counts``: the
    table (by, n), if right itself has no such column."""
    by = by or on
    total = left.count() if total is None else total
    hot = F.broadcast((right if counts is None else counts).where(F.col(n) * 1000 > total).select(*by).distinct().withColumn("_hot", F.lit(True)))  # under 1,000 keys
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(ways))).otherwise(0).cast("long").alias("_part")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    a = left.join(hot, by, "left").select(*left.columns, part)
    b = right.join(hot, by, "left").select(*right.columns, F.explode(parts).alias("_part"))
    return a.join(b, [*on, "_part"]).drop("_part")


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], Iterable[tuple]]], schema: str, rows_per_batch: int = 20_000) -> DataFrame:
    """mapInArrow over rows.

    ``make`` runs once in each task and gives a function from one input row to
    output rows; if that function has an attribute ``close``, its rows follow at
    the task's end.
    """
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rows = make(), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend(f(row))
                if len(rows) >= rows_per_batch:
                    yield to_batch(rows, out)
                    rows = []
        rows.extend(getattr(f, "close", tuple)())
        if rows:
            yield to_batch(rows, out)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema of a function's rows; its executors get the package."""
    ship(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
