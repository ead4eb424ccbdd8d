"""A count-min sketch spread over tasks: how often, at most about, each 64-bit key of a table occurs.

The table is cut into slices first, one row each, written once so that a slice is the same whenever it is read. Each slice
counts its keys in the cells of the sketch; this partial sketch is sparse (sorted cells as differences). Cells are dealt
in blocks: one task adds up what all slices counted in a block, and sends each slice the sums of those cells it has
touched. So neither the driver nor any task holds the whole sketch, and its cells grow with the keys: it filters alike
at every size. Counts are overestimates where keys share cells, never less than the truth.

A block gets at most one entry a cell from each slice, however often a key occurs there, so frequent keys make no task large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved, slices, text_batches, text_bytes
from ._words import mix

_ROW = [np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]


def sliced(docs: DataFrame, name: str, most: int = 8_000_000) -> DataFrame:
    """slice long, held binary: the rows of docs, about `most` bytes of text to a slice; one longer text is a slice of its own."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            sink = pa.BufferOutputStream()
            schema = pa.schema([f.with_nullable(True) for f in held[0].schema])  # batches of a table may differ in that
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=schema))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "held"])

        for b in slices(batches, most=most):
            more = int(text_bytes(b.column("text"))[1][-1])
            if held and size + more > most:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(b)
            size += more
        if held:
            yield row()

    return saved(text_batches(docs).mapInArrow(run, "slice long, held binary"), name)


def opened(held: bytes) -> pa.RecordBatch:
    """The rows of a slice."""
    with pa.ipc.open_stream(held) as found:
        return found.read_all().combine_chunks().to_batches()[0]


def _packed(cell: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted cells as byte planes of their differences, of which the high ones are nearly empty; then their counts."""
    steps = np.diff(cell, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes())


def _unpacked(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(raw[:4].T).view("<u4").ravel(), dtype=np.int64), raw[4]


class Sketch:
    """`rows` rows of about per_key cells for each expected key, in blocks of at most `most` cells, 24 blocks a row at least."""

    def __init__(self, expected: int, per_key: float, rows: int, most: int = 1 << 24):
        cells = max(1 << 16, int(expected * per_key))
        self.rows, self.block = rows, max(1 << 12, min(most, cells // 24))
        self.blocks = -(-cells // self.block)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        h = mix(keys ^ _ROW[row]) if row else keys
        block = (h >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)
        inside = (h & np.uint64(0xFFFFFFFF)) * np.uint64(self.block) >> np.uint64(32)
        return (block * np.uint64(self.block) + inside).astype(np.int64)

    def counted(self, slices_: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
        """slices_ with found: the levels of its cells, by block. keys_of must give a slice's keys in the same order each time."""

        def count(batches):
            for b in batches:
                for number, held in zip(b.column("slice").to_pylist(), b.column("held"), strict=True):
                    keys, at, part = keys_of(opened(held.as_buffer())), [], []
                    for r in range(self.rows):
                        cell, n = np.unique(self.cells(keys, r), return_counts=True)
                        cuts = np.searchsorted(cell, np.arange(self.blocks + 1) * self.block)
                        for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
                            mine = slice(cuts[i], cuts[i + 1])
                            at.append(r * self.blocks + int(i))
                            part.append(_packed(cell[mine] - i * self.block, n[mine]))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([number] * len(at), pa.int64()), pa.array(part, pa.binary())], names=["at", "slice", "part"])

        def add(key, frame):
            total, squeeze = np.zeros(self.block, np.uint32), zstandard.ZstdCompressor(level=1)
            found = [_unpacked(p) for p in frame["part"]]
            for cell, n in found:
                total[cell] += n
            levels = [squeeze.compress(np.floor(np.log2(total[cell])).astype(np.uint8).tobytes()) for cell, _ in found]
            return pd.DataFrame({"slice": frame["slice"], "at": key[0], "levels": levels})

        parts = slices_.mapInArrow(count, "at int, slice long, part binary")
        sums = parts.groupBy("at").applyInPandas(add, "slice long, at int, levels binary")
        return slices_.join(sums.groupBy("slice").agg(F.collect_list(F.struct("at", "levels")).alias("found")), "slice", "left")

    def levels(self, keys: np.ndarray, found: list[dict] | None) -> np.ndarray:
        """floor(log2) of the estimated count of each key of a slice; 0 is a key that certainly occurs once."""
        out, unpack = np.full(len(keys), 255, np.uint8), zstandard.ZstdDecompressor()
        by_block = {x["at"]: x["levels"] for x in found or ()}
        for r in range(self.rows):
            _, inverse = np.unique(self.cells(keys, r), return_inverse=True)
            raw = b"".join(unpack.decompress(by_block[at]) for at in range(r * self.blocks, (r + 1) * self.blocks) if at in by_block)
            out = np.minimum(out, np.frombuffer(raw, np.uint8)[inverse])
        return out
