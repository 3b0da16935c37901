"""Files of stored tables: where they are, what stands in them, and whether all are there."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LostFile

#: name: below the folder of the inventory.
INVENTORY = "name string, length bigint"
CONTENT = f"{INVENTORY}, n bigint, digest bigint"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it in spark.checkpoint.dir; a
    temporary one only where all is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run within go when each has ended.

    Else they stay until the driver happens to collect its garbage, which a large heap puts off.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before == "true":
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fs_of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands directly in a folder; nothing if there is none."""
    fs, p = fs_of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def create_only(spark: SparkSession, path: str) -> bool:
    """Makes an empty file, for one caller: False if it is there already."""
    fs, p = fs_of(spark, path)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
    except Exception as e:  # the file system's own FileAlreadyExistsException
        if fs.exists(p):
            return False
        raise e
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, *folders: str) -> DataFrame:
    """(name, length) of the Parquet files below folders, listed by Spark, contents unread.

    A name has the partition folders above the file and the folder given, so it stands once.
    """
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], INVENTORY)
    found = None
    for f in there:
        last = f.rstrip("/").rpartition("/")[2]
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f)
        own = own.select(F.concat(F.lit(f"{last}/"), F.substring_index("path", f"/{last}/", -1)).alias("name"), "length")
        found = own if found is None else found.unionByName(own)
    return found


def contents(spark: SparkSession, folder: str, table: DataFrame) -> DataFrame:
    """(name, length, n, digest) of the files of a table below a folder: rows, and a sum over
    hashes of all their columns, in any order."""
    last = folder.rstrip("/").rpartition("/")[2]
    name = F.concat(F.lit(f"{last}/"), F.substring_index(F.col("_metadata.file_path"), f"/{last}/", -1))
    hashed = F.pmod(F.xxhash64(*[F.col(c) for c in table.columns]), F.lit(1 << 31))
    rows = table.select(name.alias("name"), hashed.alias("h")).groupBy("name").agg(F.count("*").alias("n"), F.sum("h").alias("digest"))
    return listing(spark, folder).join(rows, "name", "left").select("name", "length", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("digest", F.lit(0).cast("long")).alias("digest"))


def require(stored: DataFrame, now: DataFrame) -> None:
    """Raises LostFile for a file of the inventory that is missing, new or another now."""
    columns = [c for c in stored.columns if c in now.columns and c != "name"]
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    bad = stored.alias("a").join(now.alias("b"), F.col("a.name") == F.col("b.name"), "full").where(~same).select(F.coalesce("a.name", "b.name").alias("name"), F.col("b.name").isNull().alias("gone")).limit(1).collect()
    if bad:
        raise LostFile(f"{bad[0].name} {'is missing' if bad[0].gone else 'is not what was written'}")
