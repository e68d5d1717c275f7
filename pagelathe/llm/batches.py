"""Texts in named batches, written once: what several passes read must have the same batches, whatever scans or settings change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.shared import bounded, byte_view, materialize, slices, texts

#: Text of a batch; a longer text is a batch of its own. Texts of a batch, at most.
BATCH_BYTES, BATCH_TEXTS = 5 << 20, 1 << 16
_CODEC = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes: planes of like bytes, compressed."""
    a = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(a).to_bytes(6, "little") + width.to_bytes(1, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:6], "little"), raw[6]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_CODEC.decompress(raw[7:], n * width), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def gathered_up(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to about BATCH_BYTES, and cut where they hold more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BATCH_BYTES or sum(b.num_rows for b in held) >= BATCH_TEXTS:
            for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from slices(whole, text, BATCH_BYTES)
            held = []
    if held:
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from slices(whole, text, BATCH_BYTES)


def text_batches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch: long, doc_ids: array<long>, n_bytes: long, sizes, data): docs in batches, texts compressed; a table in the shared folder.

    A batch's name is the number of the task that wrote it and a count, so it is its own even if another holds the same rows;
    rows of a failed or repeated attempt are not in the table. Null text: empty. Null key: null.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, k = pa.Codec("zstd", 3), TaskContext.get().partitionId(), 0
        for part in gathered_up(arrow, "text"):
            for at in range(0, part.num_rows, BATCH_TEXTS):
                own = part.slice(at, BATCH_TEXTS)
                data, offs = byte_view(own.column("text"))
                columns = [[task << 32 | k], [own.column("doc_id").to_pylist()], [len(data)], [pack(np.diff(offs))], [codec.compress(data.tobytes(), asbytes=True)]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["batch", "doc_ids", "n_bytes", "sizes", "data"])
                k += 1

    rows = texts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return materialize(rows.mapInArrow(bounded(run), "batch long, doc_ids array<long>, n_bytes long, sizes binary, data binary"))


def text_of(data: bytes, sizes: bytes) -> pa.Array:
    """The texts of a row of text_batches()."""
    offs = np.concatenate([[0], np.cumsum(unpack(sizes).astype(np.int64))])
    raw = pa.Codec("zstd").decompress(data, int(offs[-1])) if offs[-1] else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), raw])
