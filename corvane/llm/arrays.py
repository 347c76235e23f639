"""Arrow and numpy helpers the text operators share.

All of them work on one bounded piece of a record batch at a time, so a worker's
memory depends on ``PIECE_BYTES`` and on the longest single text, never on the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.recovery import small_batches, trimmed

#: Text bytes that a worker handles at a time; one longer text is handled alone.
PIECE_BYTES = 6 << 20
#: Rows that a worker handles at a time.
PIECE_ROWS = 4096

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that near values get unrelated hashes."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


def pieces(batches: Iterable[pa.RecordBatch], text: int | str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most ``limit`` bytes of text and PIECE_ROWS rows each, and their texts with null as ''."""
    for batch in batches:
        column = batch.column(text)
        if column.null_count:
            column = pc.fill_null(column, "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = min(max(start + 1, int(np.searchsorted(sizes, before + limit, side="right"))), start + PIECE_ROWS)
            yield batch.slice(start, end - start), column.slice(start, end - start)
            start, before = end, int(sizes[end - 1])


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def from_utf8(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """The inverse of utf8_buffer."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(texts: pa.Array) -> pa.Array:
    """The texts with A-Z, and nothing else, in lower case."""
    data, offsets = utf8_buffer(texts)
    return from_utf8(_LOWER[data], offsets)


def space_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words ``[^\\x20\\x09-\\x0D]+`` in the flat array of all words, and that array."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.values, np.asarray(lists.offsets).astype(np.int64)
    flat, offsets = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # leading or trailing space leaves empty strings
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return offsets, flat


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal exactly where the values are, and the distinct values by number."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def lengths_to_rows(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, given the n + 1 offsets of rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring offsets; empty stretches are 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def with_own_names(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns called __c0, __c1 ..., so that no result's name can meet one of them, and the new names of those that are needed."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(n)] for n in needed]


def map_texts(
    df: DataFrame,
    work: Callable[[pa.Array], dict[str, Sequence]],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    limit: int = PIECE_BYTES,
    lent: Broadcast | None = None,
) -> DataFrame:
    """The id, the columns of ``keep`` and what ``work`` returns for the texts of each bounded piece.

    ``fields`` is the DDL of the returned columns. A kept column of the same name as a
    returned one gives way to it; other columns of the input don't matter. The value of ``lent``
    leaves a worker's memory at the end of each task.
    """
    names = [f.split()[0] for f in fields.split(",")]
    kept = [c for c in dict.fromkeys(keep) if c not in names and c != id_col]
    small_batches(df.sparkSession)
    first = [f"__{i}" for i in range(len(kept) + 1)]  # own names inside, whatever the input's are
    inner = df.select(F.col(text_col).cast("string"), F.col(id_col), *[F.col(c) for c in kept]).toDF("__text", *first)
    ddl = ", ".join([f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in first] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "__text", limit):
            out = work(texts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in first] + [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[c] for c in names)], [*first, *names])

    return inner.mapInArrow(lambda batches: trimmed(run(batches), lent), ddl).toDF(id_col, *kept, *names)
