"""Token files with fixed-width bit packing (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pieces
from quarry.llm.tokenize import RUN_CHARS, encoder

BLOCK = 4096  # ids in a block; a multiple of 8, so that every block starts at a byte
CHUNK = 65_536  # ids in a row of the file, at least, as documents aren't split

#: A row of the token file. Its bits, low bit first: id i takes bits i * width to (i + 1) * width.
SCHEMA = "shard int, chunk int, first_id long, width int, n_ids long, doc_ids array<bigint>, doc_starts array<bigint>, block_offsets array<bigint>, payload binary"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(ids), BLOCK * 16):
        bits = (ids[at : at + BLOCK * 16, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def block_offsets(count: int, width: int) -> list[int]:
    """Byte offset of each block of a chunk."""
    return [i * BLOCK * width // 8 for i in range(-(-count // BLOCK))]


def unpack_bits(payload: bytes, width: int, offsets: list[int], start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) of a chunk, reading only the blocks that hold them."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    first = start // BLOCK
    raw = payload[offsets[first] : -(-stop * width // 8)]
    if width in (8, 16, 32):
        ids = np.frombuffer(raw, f"<u{width // 8}")
    else:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        bits = bits[: len(bits) // width * width].reshape(-1, width)
        ids = bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    return ids[start - first * BLOCK : stop - first * BLOCK].astype(np.uint32)


def writer(path: str, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in pieces(frames, "text", RUN_CHARS):
            ids, ends = encoder(path).encode(part["text"].tolist())
            width = width_of(max(encoder(path).vocabulary, end_id + 1))
            docs = [None if x is pd.NA else x for x in part["doc_id"].astype("Int64").tolist()]
            ids = np.insert(ids, ends[1:], np.uint32(end_id))
            ends = ends + np.arange(len(ends))
            rows, a = [], 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK)))
                b = min(b, len(docs))
                n = int(ends[b] - ends[a])
                rows.append((shard, chunk, first, width, n, docs[a:b], (ends[a:b] - ends[a]).tolist(), block_offsets(n, width), pack_bits(ids[ends[a] : ends[b]], width)))
                chunk, first, a = chunk + 1, first + n, b
            yield pd.DataFrame(rows, columns=names)

    return write


def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of the chunks: place, length and check sum."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            ids = unpack_bits(r.payload, r.width, r.block_offsets, 0, r.n_ids)
            starts = np.asarray(r.doc_starts, np.int64)
            ends = np.append(starts[1:], r.n_ids)
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            out = pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in r.doc_ids], "Int64"), "start": r.base + r.first_id + starts, "n_tokens": ends - starts, "ids_crc32": crc})
            yield out


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode all documents in ascending doc_id order and write them as a packed table; returns the table as read back.

    The table is in the shared folder. Its rows are chunks (see SCHEMA): a shard is a range of doc_ids, in order; within
    a shard first_id is the number of ids before the chunk.
    """
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(slim.mapInPandas(writer(tokenizer_path, end_id), SCHEMA), "tokens", "uncompressed")


def document_index(files: DataFrame) -> DataFrame:
    """One row per document, from the packed ids: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row for each shard of the files
    bases, at = [], 0
    for r in totals:
        bases.append((r["shard"], at))
        at += r["n"]
    base = files.sparkSession.createDataFrame(bases, "shard int, base long")
    return files.join(F.broadcast(base), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of docs, read them back and list their documents.

    Null or empty text: the end id alone. Null ids come first; rows of one id are ordered by text. Very long texts
    are one chunk. Empty input: no rows. Further columns aren't read.
    """
    return document_index(write_token_files(docs, tokenizer_path, end_id))


def read_ids(spark: SparkSession, files: DataFrame, doc_id: int) -> np.ndarray:
    """Random access: the ids of one document, from the blocks that hold them."""
    row = files.filter(F.array_contains("doc_ids", doc_id)).first()
    at = row["doc_ids"].index(doc_id)
    stop = row["doc_starts"][at + 1] if at + 1 < len(row["doc_starts"]) else row["n_ids"]
    return unpack_bits(bytes(row["payload"]), row["width"], row["block_offsets"], row["doc_starts"][at], stop)
