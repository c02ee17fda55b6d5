"""Helpers shared by the training-data operators.

Conventions of every operator here: it first selects the columns it names
(so extra columns with clashing names are harmless), a null text counts as
the empty text, and an empty table gives an empty result with the same
schema. Repeated rows (same id, same text) are kept as rows of their own.
"""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The white space that separates words and that exact dedup removes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only the two columns an operator reads."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """Each string as its UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few rows are Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


#: What a Python worker keeps from task to task: one object, of the operator that ran last.
_RESIDENT: dict[object, object] = {}


def release() -> None:
    """Give freed memory back: workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def keep_only(key: object) -> None:
    """Drop what another operator left in this worker."""
    if _RESIDENT and key not in _RESIDENT:
        _RESIDENT.clear()
        release()


def resident(key: object, make: Callable[[], object]):
    """The worker's object under this key, made at first use."""
    keep_only(key)
    if key not in _RESIDENT:
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def released(run, keep: object = None):
    """An Arrow pass that starts without other operators' objects and gives
    its memory back when its task ends."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keep)
        try:
            yield from run(batches)
        finally:
            release()

    return own


def fold_of(id_column: Column) -> Column:
    """crc32(doc_id as text) mod 5; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5


def fold_of_id(doc_id: int | None) -> int:
    """The same fold in plain Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def text_key(text_col: str = "text") -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col(text_col).cast("string"))


def keep_chosen(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs by decisions (doc_id, text_key, kept), one per decided
    row: rows without a decision stay, dropped rows go. Where identical rows
    have both decisions, one of them stays."""
    fates = cut_lineage(decided.groupBy("doc_id", "text_key").agg(F.max("kept").alias("some"), F.min("kept").alias("every")).where(~F.col("every")))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": text_key(text_col)})
    same = keyed["__id"].eqNullSafe(fates["doc_id"]) & (keyed["__key"] == fates["text_key"])
    stay = keyed.join(fates, same, "left_anti")
    mixed = fates.where("some").select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"))
    one = keyed.join(mixed, keyed["__id"].eqNullSafe(mixed["m_id"]) & (keyed["__key"] == mixed["m_key"]), "left_semi").dropDuplicates(["__id", "__key"])
    return stay.unionByName(one).select(docs.columns)
