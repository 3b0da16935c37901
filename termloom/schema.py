"""Schemas, constants and errors.

Document ids are BIGINT: ids up to 2^32 - 1 must fit and Spark has no unsigned
types.  Term ids may use all 64 bits; stored as BIGINT they order as signed.
"""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT_VERSION = 1
#: Entries of a block.
BLOCK_SIZE = 128
#: Largest id and position of the data model.
MAX_ID = 2**32 - 1

LONG = T.LongType()


def entries_schema(term: T.DataType | None = None, weight: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField("term", term or T.StringType()), T.StructField("doc_id", LONG), T.StructField("w", weight or LONG)])


DOCS = T.StructType([T.StructField("doc_id", LONG), T.StructField("doc_len", LONG)])
POSITIONS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", LONG), T.StructField("ps", T.ArrayType(T.IntegerType(), False))])
MANIFEST = T.StructType([T.StructField("segment_id", LONG), T.StructField("format_version", T.IntegerType()), T.StructField("term_count", LONG), T.StructField("doc_count", LONG), T.StructField("min_doc_id", LONG), T.StructField("max_doc_id", LONG), T.StructField("total_doc_len", LONG), T.StructField("block_size", T.IntegerType()), T.StructField("range_width", LONG), T.StructField("path", T.StringType())])


class IndexDataError(ValueError):
    """Input that no index can hold."""


class DuplicateDocId(IndexDataError):
    """A live document has this id already."""


class UnsortedDocId(IndexDataError):
    """Document ids must increase strictly."""


class NonIncreasingDocId(IndexDataError):
    """An entry list's document ids must increase strictly."""


class ZeroWeight(IndexDataError):
    """Sealed entries can't have weight zero."""


class WeightOverflow(IndexDataError):
    """A summed weight leaves 32 bits."""


class DocLengthOverflow(IndexDataError):
    """A document's length leaves 32 bits."""


class DuplicateTermId(IndexDataError):
    """A term has two entry lists."""


class UnsortedTermId(IndexDataError):
    """Terms must increase strictly."""


class EmptyEntryList(IndexDataError):
    """An entry list has no entries."""


class EmptyTerm(IndexDataError):
    """A sealed positional segment can't hold the empty term."""


class UnknownDocId(IndexDataError):
    """An entry names a document that isn't listed."""


class PositionOutOfRange(IndexDataError):
    """Positions must increase strictly and stay below the document's length."""


class ChecksumMismatch(IndexDataError):
    """Stored entries differ from what was written."""


class LostFile(ChecksumMismatch):
    """A stored file is missing, or not the one that was written."""


class DuplicateSegment(IndexDataError):
    """A published segment has this id."""


class CacheMismatch(IndexDataError):
    """A term cache of another index."""


class UnsortedIds(IndexDataError):
    """Ids must increase strictly."""


class IdOverflow(IndexDataError):
    """An id leaves 32 bits."""
