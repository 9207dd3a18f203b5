"""Blocks of whole texts, numbers for their distinct words, and folds; shared by the operators that read words."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 2 << 20
LEXICON_WORDS = 1 << 19


def schema(id_type: T.DataType, **columns: str) -> T.StructType:
    """``id`` of the given type, then columns by name and type."""
    out = T.StructType([T.StructField("id", id_type)])
    for name, kind in columns.items():
        out.add(name, T._parse_datatype_string(kind))
    return out


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``__row`` that holds the whole row, for operators that hand it on as an id."""
    return docs.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in docs.columns)))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n))


def hashed_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` ids, those of the smallest hashes."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    return rows.select("id", key.alias("key")).distinct().orderBy("key", "id").limit(n).select("id")


class Lexicon(dict):
    """Numbers distinct words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def codes(self, docs: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in a row, and how many each document has."""
        rows = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in docs]  # words of one text at a time
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.concatenate(rows) if rows else np.zeros(0, np.int32), sizes

    def since(self, n: int) -> list[bytes]:
        """Words numbered n and later."""
        return list(self)[n:] if n else list(self)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def texts_for(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The column ``text``, unless the ids are whole rows that hold it."""
    whole = isinstance(docs.schema[id_col].dataType, T.StructType)
    return [] if whole else [F.col(text_col).cast("string").alias("text")]


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch: a column, or a field of whole rows that are handed on as ids."""
    if column in batch.schema.names:
        return batch.column(column)
    return batch.column("id").field(column)


def in_task(sample: DataFrame, work):
    """``work(rows)`` over a sample of bounded size, run in a task so that its arrays don't weigh on the driver.

    The result travels back pickled; lost with its executor, the task runs again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(rows))], pa.binary())], ["result"])

    done = sample.repartition(1).mapInArrow(tidy(run), "result binary").first()
    return pickle.loads(done["result"]) if done else work([])  # no task runs for an empty sample


def release() -> None:
    """Give memory back to the system: Spark keeps Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """Let a task's function over batches give back its memory at the end."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return over


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text; a longer text is a block of its own."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text_of(batch, column)), 0), dtype=np.int64))
        start = 0
        while start < len(ends):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run gives 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ..., for each run one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift
