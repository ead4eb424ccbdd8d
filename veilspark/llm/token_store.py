"""Token ids in a chunked, plane-shuffled binary format.

Format. Documents are laid out in ascending doc_id order, cut into shards (contiguous ranges of doc_id), and each
shard's ids into blocks of `block` ids. A block's little-endian bytes are transposed: byte planes hold the first bytes
of all ids, then the second bytes, and so on; bit planes hold the lowest bits of all ids (eight to a byte), then the
next. Each plane is compressed with zstandard on its own. Two tables in Parquet, so that Spark's commit protocol
protects them and any store it writes to can hold them:

    blocks   shard, block, n_ids, width (bytes an id), bits (whether bit planes), planes array<binary>, and the
             documents in it: rows, doc_ids, no_ids (whether null), doc_starts (ids of the document before the
             block's first of it), lengths
    index    shard, block, n_ids, first_doc, last_doc, bytes: to find the blocks of a document, or of an id range,
             without reading planes

Nulls: a null text has the end id alone; a null doc_id sorts first. Rows that repeat a doc_id are documents each.
An empty table gives empty tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import before, dropped, saved, slices, text_batches
from ._tokens import encoder

BLOCKS = "shard int, block int, n_ids long, width int, bits boolean, planes array<binary>, rows array<long>, doc_ids array<long>, no_ids array<boolean>, doc_starts array<long>, lengths array<long>"


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    raw = np.ascontiguousarray(ids.astype(ids.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little") if bits else raw.T
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]) if n else np.zeros((width, 0), np.uint8)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(raw.T)
    return raw.reshape(-1).view(f"<u{width}")


def encode_documents(docs: DataFrame, path: str, end_id: int, spaces_matter: bool, ordinary: bool = False) -> DataFrame:
    """doc_id, no_id, row, n_tokens, width and the compressed ids of each document, as a table."""

    def run(batches):
        enc, squeeze = encoder(path, spaces_matter, ordinary), zstandard.ZstdCompressor(level=1)
        end = enc.dtype(end_id).tobytes()
        for b in slices(batches):
            ids = [x + end for x in enc.ids(t or "" for t in b.column("text").to_pylist())]
            width = np.dtype(enc.dtype).itemsize
            n = pa.array([len(x) // width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "no_id", "row")), n, pa.array([width] * len(ids), pa.int32()), pa.array([squeeze.compress(x) for x in ids], pa.binary())], names=["doc_id", "no_id", "row", "n_tokens", "width", "ids"])

    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.monotonically_increasing_id().alias("row"), "text")
    return saved(text_batches(named).mapInArrow(run, "doc_id long, no_id boolean, row long, n_tokens long, width int, ids binary"), "ids")


def write_store(docs: DataFrame, path: str, end_id: int, spaces_matter: bool, block: int = 65_536, bits: bool = False, per_shard: int = 8_000_000, ordinary: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks, index): the two tables of the format. Each shard is a task's sorted range of about per_shard ids.

    ordinary: strings of special tokens in a text are ordinary text; else they get their ids, as the library gives them.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        unpack = zstandard.ZstdDecompressor()
        parts, docs_in, held, width = [], [], 0, 2

        def full(n):
            nonlocal parts, docs_in, held, number
            ids = np.concatenate(parts)
            now, inside, room = ids[:n], [], n
            while docs_in and room:
                row, doc_id, no_id, start, length = docs_in[0]
                take = min(length, room)
                inside.append((row, doc_id, no_id, start, take))
                room -= take
                docs_in[:1] = [(row, doc_id, no_id, start + take, length - take)] if take < length else []
            columns = list(zip(*inside, strict=True))
            out = (shard, number, len(now), width, bits, to_planes(now, bits), *map(list, columns))
            parts, held, number = [ids[n:]], held - n, number + 1
            return out

        def table(rows):
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for doc_id, no_id, row, n, w, ids in zip(*(b.column(k).to_pylist() for k in ("doc_id", "no_id", "row", "n_tokens", "width", "ids")), strict=True):
                width = w
                parts.append(np.frombuffer(unpack.decompress(ids), f"u{w}"))
                docs_in.append((row, doc_id, no_id, 0, n))
                held += n
                while held >= block:
                    yield table([full(block)])
        if held:
            yield table([full(held)])

    ids = encode_documents(docs, path, end_id, spaces_matter, ordinary)
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    ranged = ids.repartitionByRange(max(1, -(-total // per_shard)), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    blocks = saved(ranged.mapInArrow(run, BLOCKS), "blocks")
    index = saved(blocks.select("shard", "block", "n_ids", F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"), F.aggregate("planes", F.lit(0), lambda a, p: a + F.length(p)).alias("bytes")), "index")
    dropped(ids)
    return blocks, index


def crc_joined(one: int, two: int, length: int) -> int:
    """crc32 of two byte strings put together, from their own crc32 and the second one's length."""

    def times(a: int, b: int) -> int:  # product of polynomials modulo CRC-32's, lowest power in the highest bit
        out = 0
        for i in range(32):
            if a >> (31 - i) & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, n = 1 << 31, 1 << 30, 8 * length  # x^0; x^1
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(power, one) ^ two


def _bases(index: DataFrame) -> DataFrame:
    """shard, block, base: ids before each block."""
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shard_base = before(shards, [], "shard", "n", "shard_base").select("shard", "shard_base")
    block_base = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.select("shard", "block", block_base.alias("before")).join(shard_base, "shard").select("shard", "block", (F.col("shard_base") + F.col("before")).alias("base"))


def read_range(blocks: DataFrame, index: DataFrame, begin: int, end: int) -> DataFrame:
    """at, id: the ids at places begin to end - 1 of all. The index names the blocks that hold them; only those are decoded."""

    def run(frames):
        for f in frames:
            for x in f.itertuples(index=False):
                low, high = max(0, begin - x.base), min(x.n_ids, end - x.base)
                ids = from_planes(list(x.planes), x.n_ids, x.width, x.bits)[low:high]
                yield pd.DataFrame({"at": np.arange(x.base + low, x.base + high), "id": ids.astype(np.int64)})

    wanted = index.join(_bases(index), ["shard", "block"]).where((F.col("base") < end) & (F.col("base") + F.col("n_ids") > begin))
    held = blocks.join(wanted.select("shard", "block", "base"), ["shard", "block"])
    return held.select("base", "n_ids", "width", "bits", "planes").mapInPandas(run, "at long, id long")


def read_documents(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of little-endian 32-bit ids) of each document.

    Blocks are decoded where they lie; only a row for each document and block is shuffled. A document's pieces are put
    together from their checksums.
    """

    def run(frames):
        for f in frames:
            rows = []
            for x in f.itertuples(index=False):
                ids, at = from_planes(list(x.planes), x.n_ids, x.width, x.bits), 0
                for row, doc_id, no_id, start, n in zip(x.rows, x.doc_ids, x.no_ids, x.doc_starts, x.lengths, strict=True):
                    rows.append((row, doc_id, no_id, x.base + at, start, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
                    at += n
            yield pd.DataFrame(rows, columns=["row", "doc_id", "no_id", "at", "in_doc", "n", "crc"])

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        def one(pieces):
            pieces = sorted(pieces, key=lambda p: p["in_doc"])
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = crc_joined(crc, p["crc"], 4 * p["n"])
            return crc

        return parts.map(one)

    base = _bases(index)
    pieces = blocks.join(base, ["shard", "block"]).mapInPandas(run, "row long, doc_id long, no_id boolean, at long, in_doc long, n long, crc long")
    docs = pieces.groupBy("row", "doc_id", "no_id").agg(F.min("at").alias("start"), F.sum("n").alias("n_tokens"), F.min("crc").alias("crc"), F.count("*").alias("k"), F.collect_list(F.struct("in_doc", "n", "crc")).alias("parts"))
    crc = F.when(F.col("k") == 1, F.col("crc")).otherwise(joined("parts"))
    return docs.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", crc.alias("ids_crc32"))
