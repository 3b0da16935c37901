"""Stored indexes: snapshots, and immutable segments under a manifest.

Entries, positions and documents of a segment lie in folders by range of document ids, in
each of them in order of term and document.  So a set of ranges becomes partition filters,
a term file and row-group statistics, and a frequent term spans files.  Where a seal would
make many small folders, its segments share files instead (a packed batch): each holds whole
documents of some ranges in order of term and document, segment and range are columns, and
the statistics of files and pages skip what the folders would.  A segment exists
once a manifest file names its folder; that file is written last.  Object stores and
HDFS publish a file whole when it is closed or renamed, which is the durability given
here: there is no fsync.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bitmaps
from ..functions.tokens import tokenised
from ..operators.build import RANGE, Index, block_table, index_in_place, index_texts, term_stats
from ..operators.score import in_ranges
from ..schema import (
    BLOCK_SIZE, DOCS, FORMAT_VERSION, MANIFEST, MAX_ID, POSITIONS, ChecksumMismatch, DocLengthOverflow, DuplicateDocId, DuplicateSegment, DuplicateTermId, EmptyEntryList, EmptyTerm, IndexDataError, LostFile,
    NonIncreasingDocId, PositionOutOfRange, UnknownDocId, UnsortedDocId, UnsortedTermId, WeightOverflow, ZeroWeight,
)
from . import files
from .files import shared_dir  # noqa: F401

POINTER = "version string, term string, weight string, positional boolean"
#: Kept by Parquet for each row group of a sorted term column: statistics that let other terms be skipped.
ROWS_PER_FILE = 4_000_000
#: Ids of a range of documents, each a folder; ids and terms that share a checksum.
RANGE_WIDTH, CHECKED_IDS, CHECKED_TERMS = 1 << 20, 4096, 64
#: More folders than these, with fewer tokens each than a task gets, become shared files.
FOLDERS, TASK = 64, 1 << 19
#: Bytes of a text for each token, as a guess from which tasks are sized.
BYTES = 6
#: Terms with lists of several blocks that are broadcast.
LONG = 100_000


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published snapshots, of which the largest counts."""
    done = [n for n in files.names(spark, f"{path}/pointers") if n.isdigit() and files.exists(spark, f"{path}/pointers/{n}/_SUCCESS")]
    return sorted(map(int, done))


def _tables(spark: SparkSession, at: str, term: str, weight: str, positional: bool) -> dict[str, DataFrame]:
    kinds = {"entries": f"term {term}, doc_id bigint, w {weight}", "docs": DOCS} | ({"positions": POSITIONS} if positional else {})
    return {name: spark.read.schema(kind).parquet(f"{at}/{name}") for name, kind in kinds.items()}


def save(index: Index, path: str) -> None:
    """A snapshot of a live index; a reader sees the old one or the new one.

    The new tables go to a folder of their own, then an inventory of their files: names,
    lengths, rows and a digest of what was written.  Then a pointer with the next number is
    written, which counts once its write has succeeded; none is ever replaced or removed,
    so a reader finds one at any time.  Of two that save at once one may fail.
    """
    spark = index.docs.sparkSession
    version = f"v{uuid.uuid4().hex}"
    at, kind, positional = f"{path}/{version}", dict(index.entries.dtypes), index.positions is not None
    if positional:
        index.positions.write.parquet(f"{at}/positions")
    index.entries.write.parquet(f"{at}/entries")
    index.docs.write.parquet(f"{at}/docs")
    _contents(spark, at, _tables(spark, at, kind["term"], kind["w"], positional)).coalesce(1).write.parquet(f"{at}/inventory")
    number = max(_pointers(spark, path), default=0) + 1
    spark.createDataFrame([(version, kind["term"], kind["w"], positional)], POINTER).coalesce(1).write.json(f"{path}/pointers/{number}")


def _contents(spark: SparkSession, at: str, tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        own = files.contents(spark, f"{at}/{name}", df)
        out = own if out is None else out.unionByName(own)
    return out


def load(spark: SparkSession, path: str, verify: bool = True) -> Index:
    """The snapshot last saved.  A file that is missing, new or of another length raises
    LostFile, and so does one whose rows differ from what was written: that takes a pass over
    all rows, which ``verify=False`` leaves out."""
    numbers = _pointers(spark, path)
    if not numbers:
        raise IndexDataError(f"no snapshot at {path}")
    c = spark.read.schema(POINTER).json(f"{path}/pointers/{numbers[-1]}").first()
    at = f"{path}/{c.version}"
    if not files.exists(spark, f"{at}/inventory/_SUCCESS"):
        raise LostFile(f"no inventory of {c.version}")
    inventory = spark.read.schema(files.CONTENT).parquet(f"{at}/inventory")
    kinds = ["entries", "docs"] + ["positions"] * bool(c.positional)
    files.require(inventory.select("name", "length"), files.listing(spark, *[f"{at}/{k}" for k in kinds]))
    tables = _tables(spark, at, c.term, c.weight, c.positional)
    if verify:
        try:
            files.require(inventory, _contents(spark, at, tables))
        except LostFile:
            raise
        except Exception as e:  # what a damaged file makes Spark's reader raise depends on where the damage is
            raise LostFile(f"{c.version} can't be read: {str(e)[:300]}") from e
    return Index(tables["entries"], tables["docs"], tables.get("positions"))


def _first(df: DataFrame):
    rows = df.limit(1).collect()
    return rows[0] if rows else None


def _first_unsorted(df: DataFrame, key: str, order: str):
    """A row whose key isn't above all those before it in the given order, or None.

    Ranges of the order are looked at each for itself; then their ends are compared.
    """
    ranged = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    before = F.lag(key).over(Window.partitionBy("_range").orderBy(order))
    if r := _first(ranged.withColumn("_before", before).where(F.col(key) <= F.col("_before"))):
        return r
    ends = ranged.groupBy("_range").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("_range").collect()  # a row for each partition
    return next((b for a, b in zip(ends, ends[1:], strict=False) if b.low <= a.high), None)


def validate_document_lengths(docs: DataFrame, order: str | None = None) -> None:
    """Ids stand once (and, given an order column, increase in it); lengths fit 32 bits."""
    if r := _first(docs.groupBy("doc_id").count().where("count > 1")):
        raise DuplicateDocId(str(r))
    if order and (r := _first_unsorted(docs, "doc_id", order)):
        raise UnsortedDocId(str(r))
    if r := _first(docs.where((F.col("doc_len") < 0) | (F.col("doc_len") > MAX_ID))):
        raise DocLengthOverflow(str(r))


def validate_term_lists(lists: DataFrame, order: str | None = None) -> None:
    """Lists (term, entries) as callers bring them: none is empty, terms stand once
    (and, given an order column, increase in it)."""
    if r := _first(lists.where(F.size("entries") == 0).select("term")):
        raise EmptyEntryList(str(r))
    if r := _first(lists.groupBy("term").count().where("count > 1")):
        raise DuplicateTermId(str(r))
    if order and (r := _first_unsorted(lists.select("term", order), "term", order)):
        raise UnsortedTermId(str(r))


def audit_entries(entries: DataFrame, docs: DataFrame, repeats: bool = True) -> DataFrame:
    """(violation, n): duplicates, zero weights, weights beyond 32 bits, unknown documents.

    repeats: whether duplicates are looked for, which shuffles all entries; all else is
    aggregated by document where it is read.
    """
    dup = entries.groupBy("term", "doc_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("non_increasing_doc").alias("violation"), "n")
    sums = entries.agg(F.count_if(F.col("w") == 0).alias("zero_weight"), F.count_if(F.col("w") > MAX_ID).alias("weight_overflow"))
    flat = sums.select(F.explode(F.map_from_arrays(F.array(F.lit("zero_weight"), F.lit("weight_overflow")), F.array("zero_weight", "weight_overflow"))).alias("violation", "n"))
    unknown = entries.groupBy("doc_id").agg(F.count("*").alias("n")).join(docs, "doc_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n")).select(F.lit("unknown_doc").alias("violation"), "n")
    twice = docs.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_doc").alias("violation"), "n")
    return (dup.union(flat) if repeats else flat).union(unknown).union(twice)


_ENTRY_ERRORS = {"non_increasing_doc": NonIncreasingDocId, "zero_weight": ZeroWeight, "weight_overflow": WeightOverflow, "unknown_doc": UnknownDocId, "duplicate_doc": DuplicateDocId}


def validate_entries(entries: DataFrame, docs: DataFrame, lists: DataFrame | None = None, repeats: bool = True) -> None:
    """Raises the error of the first kind of violation.  lists: (term, entries
    array) as callers bring them, to find empty and repeated ones.  repeats: as for
    :func:`audit_entries`; entries that were grouped by term and document have none."""
    if lists is not None:
        validate_term_lists(lists)
    for r in audit_entries(entries, docs, repeats).where("n > 0").collect():
        raise _ENTRY_ERRORS[r.violation](f"{r.n} entries")


def validate_positions(positions: DataFrame, docs: DataFrame) -> None:
    """No empty term; positions increase strictly and stay below the document's length.

    Lists are looked at where they are read; of a document only its bounds are shuffled.
    """
    falls = F.when(F.size("ps") > 1, F.col("ps") != F.sort_array(F.array_distinct("ps"))).otherwise(False)
    own = positions.groupBy("doc_id").agg(F.max(F.col("term") == "").alias("_empty"), F.max(falls).alias("_falls"), F.max(F.array_max("ps")).alias("_last"), F.min(F.array_min("ps")).alias("_least"))
    placed = own.join(docs.select("doc_id", "doc_len", F.lit(True).alias("_known")), "doc_id", "left")
    outside = F.col("_falls") | (F.col("_last") >= F.col("doc_len")) | (F.col("_least") < 0)
    fault = F.when(F.col("_empty"), 0).when(F.col("_known").isNull(), 1).when(outside, 2)
    if r := _first(placed.select("doc_id", fault.alias("fault")).where("fault is not null").orderBy("fault")):
        raise (EmptyTerm, UnknownDocId, PositionOutOfRange)[r.fault](str(r))


def from_term_lists(docs: DataFrame, lists: DataFrame) -> Index:
    """An index from ready entry lists (term, entries: array of struct(doc_id, w))."""
    return Index(lists.select("term", F.explode("entries").alias("x")).select("term", "x.doc_id", "x.w"), docs)


def _in_order(rows: DataFrame, order: str, key: str) -> DataFrame:
    """rows in ranges of ``order``, with the number of the task and whether their key isn't above
    the one before: -1 below, 0 the same, 1 above.  It is part of the pass that writes them."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_task", F.spark_partition_id())
    names = ranged.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in ranged.dtypes) + ", _step int"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        last = None
        for b in batches:
            if b.num_rows:
                keys = b.column(names.index(key))
                before = pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, len(keys) - 1)])
                step = pc.subtract(pc.cast(pc.greater(keys, before), pa.int32()), pc.cast(pc.less(keys, before), pa.int32()))
                last = keys[len(keys) - 1].as_py()
                yield pa.RecordBatch.from_arrays([*b.columns, pc.fill_null(step, 1)], names=[*names, "_step"])

    return ranged.mapInArrow(run, schema)


def _require_order(written: DataFrame, key: str) -> None:
    """Raises unless keys rise in all tasks of :func:`_in_order` and from each to the next."""
    ends = written.groupBy("_task").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.min("_step").alias("step")).orderBy("_task").collect()  # a row for each task
    steps = [r.step for r in ends] + [(b.low > a.high) - (b.low < a.high) for a, b in zip(ends, ends[1:], strict=False)]
    if min(steps, default=1) < 0:
        raise UnsortedTermId("terms don't increase")
    if min(steps, default=1) == 0:
        raise DuplicateTermId("a term stands twice")


@dataclass(frozen=True)
class SegmentStore:
    """Sealed segments under one folder.

    width: ids of a range of documents, for segments that are sealed from now on.
    """

    spark: SparkSession
    path: str
    width: int = RANGE_WIDTH

    def table(self, name: str, schema: str, batches: Iterable[str] | None = None) -> DataFrame:
        """A table of all published segments."""
        full = f"{schema}, segment_id bigint" + ", doc_range bigint" * (name in ("entries", "docs", "positions"))
        own = [b for b in (self._batches() if batches is None else batches) if self._exists(f"{name}/batch={b}")]
        out = None
        for kind in (False, True):
            paths = [f"{self.path}/{name}/batch={b}" for b in own if _packed(b) == kind]
            if paths:
                rows = self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(*paths).drop("batch")
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], full) if out is None else out

    def _batches(self) -> list[str]:
        """The folders that the manifest names, one for each seal."""
        return sorted(r.path for r in self.manifest().select("path").distinct().collect())

    def _exists(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.path}/{name}")

    def seal(self, index: Index, segment_id: int | None = None, by: Column | None = None, checked: bool = True, order: str | None = None) -> None:
        """Writes an index as a segment, or as several by a column expression of doc_id.

        The index is made once, into a staging folder; from there all goes to folders of its
        own in the order of a segment, and what describes them is made of what was written.
        The manifest names the segments last: a run that fails leaves nothing that a reader
        sees.  An id that is published is refused; of two seals of one id at once, the one
        that comes second.  ``order``: a column of docs in which their ids must increase.
        """
        if order:
            validate_document_lengths(index.docs, order)
        batch, tag = uuid.uuid4().hex, by if by is not None else F.lit(segment_id)
        docs = self._staged(index.docs.select("doc_id", "doc_len"), batch, "docs")
        entries = index.entries.select("term", "doc_id", "w")
        positions = None
        if index.positions is not None:
            positions = index.positions.select("term", "doc_id", "ps")
            counted = positions.select("term", "doc_id", F.size("ps").cast("long").alias("w"))
            same = counted.sameSemantics(entries)
            positions = self._staged(positions, batch, "positions")
            entries = positions.select(*counted.columns[:2], F.size("ps").cast("long").alias("w")) if same else self._staged(entries, batch, "entries")
        else:
            entries = self._staged(entries, batch, "entries")
        self._seal(batch, docs, entries, positions, tag, checked)

    def seal_texts(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", positional: bool = False, segment_id: int | None = None, by: Column | None = None, checked: bool = True) -> None:
        """Seals the index of texts, as :meth:`seal` does.

        Where segments share files, texts are brought into the order of their ids, in tasks of
        TASK tokens or so, and their tokens are grouped and written where they are: neither
        tokens nor entries are shuffled, nothing is staged, and a document's length is the sum
        of its entries' weights.
        """
        texts = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        tag = by if by is not None else F.lit(segment_id)
        sizes = texts.select("doc_id", (F.octet_length("text") / BYTES).alias("doc_len"))
        folders, tokens, _, most = self._extent(sizes, tag)
        if not _many(folders, tokens, most):
            return self.seal(index_texts(texts, positional=positional, bulk=True), segment_id, by, checked)
        validate_document_lengths(sizes)
        index = index_in_place(tokenised(texts.repartitionByRange(math.ceil((tokens + 1) / TASK), "doc_id")), positional)
        self._seal(uuid.uuid4().hex, texts.select("doc_id"), None if positional else index.entries, index.positions, tag, checked, placed=True)

    def _extent(self, docs: DataFrame, tag: Column) -> tuple[int, int, int, int]:
        """Folders by segment and range that documents (doc_id, doc_len) take, their tokens, the
        documents of the largest segment and the tokens of the largest folder."""
        at = docs.groupBy(tag.cast("long").alias("s"), F.floor(F.col("doc_id") / self.width).alias("r")).agg(F.count("*").alias("n"), F.sum("doc_len").alias("tokens"))
        per = at.groupBy("s").agg(F.count("*").alias("folders"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.max("tokens").alias("most"))
        return tuple(int(x or 0) for x in per.agg(F.sum("folders"), F.sum("tokens"), F.max("n"), F.max("most")).first())

    def seal_lists(self, docs: DataFrame, lists: DataFrame, order: str, segment_id: int) -> None:
        """Writes ready entry lists (term, entries: array of struct(doc_id, w)) that come in the
        order of a column: UnsortedTermId, DuplicateTermId, EmptyEntryList and NonIncreasingDocId
        are raised from what one pass over them finds while it stages them; nothing is sealed then."""
        batch = uuid.uuid4().hex
        ids = F.col("entries.doc_id")
        falls = F.exists(F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: a >= b), lambda x: x)
        rows = lists.select("term", "entries", order, (F.size("entries") == 0).alias("_empty"), F.coalesce(falls, F.lit(False)).alias("_falls"))
        written = self._staged(_in_order(rows, order, "term"), batch, "lists")
        _require_order(written, "term")
        if r := _first(written.where("_empty or _falls").select("term", "_empty")):
            raise (EmptyEntryList if r["_empty"] else NonIncreasingDocId)(str(r.term))
        entries = written.select("term", F.explode("entries").alias("x")).select("term", "x.doc_id", "x.w")
        self._seal(batch, self._staged(docs.select("doc_id", "doc_len"), batch, "docs"), entries, None, F.lit(segment_id), True)

    def _staged(self, df: DataFrame, batch: str, name: str) -> DataFrame:
        path = f"{self.path}/staging/batch={batch}/{name}"
        with files.shuffles_end(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _seal(self, *args, **kwargs) -> None:
        with files.shuffles_end(self.spark):
            self._write_all(*args, **kwargs)

    def _write_all(self, staged: str, docs: DataFrame, entries: DataFrame | None, positions: DataFrame | None, tag: Column, checked: bool, placed: bool = False) -> None:
        """placed: entries or positions come grouped by term and document, whole documents to a
        task, for shared files; lengths of docs are then made of them, and without entries
        these are made of the positions."""
        folders, tokens, largest, most = self._extent(docs if "doc_len" in docs.columns else docs.withColumn("doc_len", F.lit(0)), tag)
        packed = placed or _many(folders, tokens, most)
        batch = f"{'p' if packed else 'b'}{staged}"

        def write(df: DataFrame, name: str, *cols: str, placed: bool = False) -> DataFrame:
            """In ranges of the segment and the columns; the tables of documents also by their range.
            Shared files: documents in ranges, unless they are placed, and rows of terms as the
            aggregate that makes them has dealt them out; in each by the columns first."""
            by = ["segment_id"]
            rows = df if "segment_id" in df.columns else df.withColumn("segment_id", tag.cast("long"))
            if name in ("docs", "entries", "positions"):
                by.append("doc_range")
                rows = rows if "doc_range" in df.columns else rows.withColumn("doc_range", F.floor(F.col("doc_id") / self.width))
            path = f"{self.path}/{name}/batch={batch}"
            if packed:
                if "doc_id" in df.columns and not placed:
                    rows = rows.repartitionByRange(*by, "doc_id")
                rows.sortWithinPartitions(*cols, *(by if "doc_id" not in cols else [])).write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").parquet(path)
            else:
                rows.repartitionByRange(*by, *cols).sortWithinPartitions(*by, *cols).write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*by).parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        if r := _first(self.manifest().join(docs.select(tag.cast("long").alias("segment_id")).distinct(), "segment_id", "left_semi")):
            raise DuplicateSegment(f"segment {r.segment_id} is published")
        if not placed:
            docs = write(docs, "docs", "doc_id")
        if positions is not None:
            positions = write(positions, "positions", "term", "doc_id", placed=placed)
            if entries is None:  # files keep their order, so there is nothing to be dealt out anew
                entries = positions.select("term", "doc_id", F.size("ps").cast("long").alias("w"), "segment_id", "doc_range")
        entries = write(entries, "entries", "term", "doc_id", placed=placed)
        if placed:
            lengths = entries.groupBy("doc_id").agg(F.sum("w").alias("doc_len"))
            docs = write(docs.join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0).cast("long")).alias("doc_len")), "docs", "doc_id")
        if checked:
            validate_document_lengths(docs)
            validate_entries(entries, docs, repeats=not placed)
            if positions is not None:
                validate_positions(positions, docs)
        ranges = write(term_stats(entries, "segment_id", "doc_range"), "ranges", "term", "doc_range")
        terms = write(term_stats(entries, "segment_id", checksum=checksum(), _last=F.max("doc_id")), "terms", "term")
        blocks = write(_blocks(entries, terms, largest <= RANGE), "blocks", "term", "block_no")
        written = {"docs": docs, "entries": entries, "positions": positions, "blocks": blocks, "ranges": ranges, "terms": terms.drop("_last")}
        sums = None
        for name, df in written.items():
            own = block_checksums(name, df, F.lit(packed)) if df is not None else None
            sums = own if sums is None else sums.unionByName(own) if own is not None else sums
        write(sums, "checksums", "tab", "part", "block")
        folders = [f"{self.path}/{name}/batch={batch}" for name in (*written, "checksums")]
        inventory = None
        for f in folders:
            own = files.listing(self.spark, f).select(F.lit(f.split("/")[-2]).alias("tab"), "name", "length")
            inventory = own if inventory is None else inventory.unionByName(own)
        inventory.coalesce(1).write.parquet(f"{self.path}/files/batch={batch}")
        counts = terms.groupBy("segment_id").agg(F.count("*").alias("term_count"))
        total = docs.groupBy("segment_id").agg(F.count("*").alias("doc_count"), F.min("doc_id").alias("min_doc_id"), F.max("doc_id").alias("max_doc_id"), F.sum("doc_len").alias("total_doc_len"))
        rows = total.join(counts, "segment_id", "left").select(
            "segment_id", F.lit(FORMAT_VERSION).alias("format_version"), F.coalesce("term_count", F.lit(0)).alias("term_count"), "doc_count", "min_doc_id", "max_doc_id", "total_doc_len",
            F.lit(BLOCK_SIZE).alias("block_size"), F.lit(self.width).cast("long").alias("range_width"), F.lit(batch).alias("path"),
        ).collect()  # a row for each segment of this seal
        own = [r.segment_id for r in rows]
        with ThreadPoolExecutor(8) as pool:
            for segment, made in zip(own, pool.map(lambda n: files.create_only(self.spark, f"{self.path}/published/{n}"), own), strict=True):
                if not made:
                    raise DuplicateSegment(f"segment {segment} is published, or was when a seal broke off: remove {self.path}/published/{segment} if no manifest names it")
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        files.remove(self.spark, f"{self.path}/staging/batch={staged}")

    def manifest(self) -> DataFrame:
        there = self._exists("manifest")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest") if there else self.spark.createDataFrame([], MANIFEST)

    def entries(self, term: str = "string", weight: str = "bigint") -> DataFrame:
        return self.table("entries", f"term {term}, doc_id bigint, w {weight}")

    def docs(self) -> DataFrame:
        return self.table("docs", "doc_id bigint, doc_len bigint")

    def positions(self) -> DataFrame:
        return self.table("positions", "term string, doc_id bigint, ps array<int>")

    def blocks(self, term: str = "string", weight: str = "bigint") -> DataFrame:
        return self.table("blocks", f"term {term}, block_no bigint, base_doc_id bigint, last_doc_id bigint, n bigint, max_weight {weight}")

    def terms(self, term: str = "string", weight: str = "bigint") -> DataFrame:
        return self.table("terms", f"term {term}, df bigint, total_weight {weight}, max_weight {weight}, min_weight {weight}, all_finite boolean, checksum bigint")

    def ranges(self, term: str = "string", weight: str = "bigint") -> DataFrame:
        """Statistics of each term in each range of documents; here doc_range is no folder."""
        return self.table("ranges", f"term {term}, doc_range bigint, df bigint, total_weight {weight}, max_weight {weight}, min_weight {weight}, all_finite boolean")

    def statistics(self, term: str = "string", weight: str = "bigint") -> DataFrame:
        """(term, df, total_weight, max_weight, min_weight, all_finite) over all segments, from what
        is stored; documents that were deleted after sealing count."""
        return _summed(self.terms(term, weight), "term")

    def delete(self, ids: DataFrame) -> None:
        """Hides documents (doc_id) from now on; ids that no segment has do no harm.

        Their bitmap is a file of its own, so nothing sealed is rewritten, and deletes at
        once don't hinder each other.
        """
        bitmaps.bitmap_of(ids).coalesce(1).write.parquet(f"{self.path}/tombstones/t{uuid.uuid4().hex}")

    def hidden(self) -> DataFrame | None:
        """The bitmap of all deleted documents, None if there are none."""
        own = [f"{self.path}/tombstones/{n}" for n in files.names(self.spark, f"{self.path}/tombstones") if self._exists(f"tombstones/{n}/_SUCCESS")]
        if not own:
            return None
        rows = self.spark.read.schema(bitmaps.SCHEMA).parquet(*own)
        return rows if len(own) == 1 else bitmaps.union(rows)

    def visible(self, df: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
        """Rows of documents that aren't deleted, told apart where they are scanned."""
        hidden = self.hidden() if hidden is None else hidden
        return df if hidden is None else bitmaps.select(df, hidden, inside=False)

    def open(self, segment_id: int | None = None) -> Index:
        """One segment, or all, as an index, without deleted documents.

        A file that is missing, new or of another length raises LostFile.
        """
        self.require_files()
        hidden = self.hidden()
        pick = lambda df: self.visible(df if segment_id is None else df.where(F.col("segment_id") == segment_id), hidden).drop("doc_range")
        return Index(pick(self.entries()), pick(self.docs()), pick(self.positions()))

    def require_files(self) -> None:
        """Compares names and lengths of all files with the inventories; no file is opened."""
        for b in self._batches():
            stored = self.spark.read.schema(f"tab string, {files.INVENTORY}").parquet(f"{self.path}/files/batch={b}")
            tables = [r.tab for r in stored.select("tab").distinct().collect()]
            now = None
            for t in tables:
                own = files.listing(self.spark, f"{self.path}/{t}/batch={b}").select(F.concat(F.lit(f"{t}/"), "name").alias("name"), "length")
                now = own if now is None else now.unionByName(own)
            files.require(stored.select(F.concat("tab", F.lit("/"), "name").alias("name"), "length"), now)

    def faults(self) -> DataFrame:
        """(tab, segment_id, part, block, stored_n, n): where stored tables aren't what was
        written, rows that changed, went or came.

        All tables are read once and compared by part (a range of documents, or for tables of
        terms a share of them); only parts that differ are read again, by block of
        CHECKED_IDS ids or one of CHECKED_TERMS shares.
        """
        stored = self.table("checksums", "tab string, part bigint, block bigint, n bigint, crc bigint")
        key = ["tab", "segment_id", "part"]

        def differing(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
            a = a.groupBy(*on).agg(F.sum("n").alias("stored_n"), F.sum("crc").alias("stored_crc"))
            b = b.groupBy(*on).agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
            return a.join(b, [*on], "full").where(~F.col("stored_crc").eqNullSafe(F.col("crc")) | ~F.col("stored_n").eqNullSafe(F.col("n"))).select(*on, "stored_n", "n")

        tables = self._checked_tables()
        coarse = None
        for name, df in tables.items():
            own = part_checksums(name, df)
            coarse = own if coarse is None else coarse.unionByName(own)
        suspects = differing(stored, coarse, *key).select(*key).collect()  # few, or the store is lost
        packed = F.col("segment_id").isin([r.segment_id for r in self.manifest().where("path like 'p%'").where(F.col("segment_id").isin([r.segment_id for r in suspects])).collect()])
        out = self.spark.createDataFrame([], "tab string, segment_id bigint, part bigint, block bigint, stored_n bigint, n bigint")
        for name, df in tables.items():
            own = [(r.segment_id, r.part) for r in suspects if r.tab == name]
            if own:
                here = F.struct("segment_id", "part").isin([F.struct(F.lit(x).cast("long"), F.lit(y).cast("long")) for x, y in own])
                reread = block_checksums(name, df.where(in_ranges(own)) if name in ("docs", "entries", "positions") else df.where(F.col("segment_id").isin([s for s, _ in own])), packed)
                out = out.unionByName(differing(stored.where(F.col("tab") == name).where(here), reread.where(here), *key, "block"))
        return out

    def _checked_tables(self) -> dict[str, DataFrame]:
        return {"docs": self.docs(), "entries": self.entries(), "positions": self.positions(), "blocks": self.blocks(), "ranges": self.ranges(), "terms": self.terms()}

    def verify(self) -> None:
        """Raises LostFile or ChecksumMismatch unless all stored tables are what was written."""
        self.require_files()
        if r := _first(self.faults()):
            raise ChecksumMismatch(str(r))

    def _size(self, *tables: str) -> int:
        total = 0
        for b in self._batches():
            for t in tables:
                fs, p = files.fs_of(self.spark, f"{self.path}/{t}/batch={b}")
                total += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        return total

    def resident_metadata_len(self) -> int:
        """Bytes of the tables that describe entries."""
        return self._size("terms", "ranges", "blocks", "docs")

    def entry_payload_len(self) -> int:
        """Bytes of the entries and positions themselves."""
        return self._size("entries", "positions")


def _packed(batch: str) -> bool:
    return batch.startswith("p")


def _many(folders: int, tokens: int, most: int) -> bool:
    """Whether folders are many and small, the largest too."""
    return folders > FOLDERS and tokens < folders * TASK and most < FOLDERS * TASK


def _blocks(entries: DataFrame, terms: DataFrame, bounded: bool) -> DataFrame:
    """The block table of segments, of which terms has each list's length, last document and
    largest weight: that is all there is to say of a list of one block, so only entries of longer
    ones are numbered.  bounded: no list is longer than a range of ids that are numbered together."""
    short = terms.where(F.col("df") <= BLOCK_SIZE).select("segment_id", "term", F.lit(0).cast("long").alias("block_no"), F.lit(0).cast("long").alias("base_doc_id"), F.col("_last").alias("last_doc_id"), F.col("df").alias("n"), "max_weight")
    more = terms.where(F.col("df") > BLOCK_SIZE)
    some = more.select("term").distinct()
    some = F.broadcast(some) if some.limit(LONG + 1).count() <= LONG else some
    rows = entries.join(some, "term", "left_semi")
    return short.unionByName(block_table(rows, BLOCK_SIZE, "segment_id", bounded=bounded).join(more.select("segment_id", "term"), ["segment_id", "term"], "left_semi").select(*short.columns))


def _summed(stats: DataFrame, *by: str) -> DataFrame:
    """Statistics of terms put together."""
    sums = [F.sum("df").alias("df"), F.sum("total_weight").alias("total_weight"), F.max("max_weight").alias("max_weight"), F.min("min_weight").alias("min_weight"), F.bool_and("all_finite").alias("all_finite")]
    return stats.groupBy(*by).agg(*sums)


def checksum() -> Column:
    """Of an entry list: the sum of its rows' CRC32, so the order of rows doesn't matter."""
    return F.sum(F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("w").cast("string")).cast("binary")))


def _row_crc(df: DataFrame) -> Column:
    own = sorted(c for c in df.columns if c not in ("segment_id", "doc_range"))
    return F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in own]).cast("binary"))


def _part(name: str) -> Column:
    return F.col("doc_range") if name in ("docs", "entries", "positions") else F.pmod(F.xxhash64("term"), F.lit(CHECKED_TERMS))


def part_checksums(name: str, df: DataFrame) -> DataFrame:
    """(tab, segment_id, part, n, crc) of a stored table."""
    return df.groupBy(F.lit(name).alias("tab"), "segment_id", _part(name).alias("part")).agg(F.count("*").alias("n"), F.sum(_row_crc(df)).alias("crc"))


def block_checksums(name: str, df: DataFrame, packed: Column) -> DataFrame:
    """The same by block: of CHECKED_IDS ids, or one of CHECKED_TERMS shares of a part's terms.
    packed: whether a row's segment shares files; a part of its terms is one block, as it is small."""
    share = F.pmod(F.shiftright(F.xxhash64("term"), 16), F.lit(CHECKED_TERMS)) if "term" in df.columns else None
    block = F.floor(F.col("doc_id") / CHECKED_IDS) if "doc_id" in df.columns else F.when(packed, F.lit(0).cast("long")).otherwise(share)
    return df.groupBy(F.lit(name).alias("tab"), "segment_id", _part(name).alias("part"), block.alias("block")).agg(F.count("*").alias("n"), F.sum(_row_crc(df)).alias("crc"))
