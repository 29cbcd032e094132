"""Cost-balanced packing into fixed-length sequences (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.common import pieces
from quarry.llm.tokenize import KEPT_PIECES, RUN_CHARS, encoder

#: doc, start in the document, length, sequence, offset in the sequence
Piece = tuple[int, int, int, int, int]


def balance(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None) -> list[Piece]:
    """Deal documents (by length, each up to capacity) to sequences: descending, each to the lowest cost that has room.

    The cost of a piece is linear * n + quadratic * n * n: its matrix products and its attention. As many sequences are
    opened as the tokens need at least; a document that no longer fits anywhere is cut into the rooms left, so all
    sequences together have less than one capacity of padding. Ties: the lower index.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    count = -(-int(lengths.sum()) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity)
    out: list[Piece] = []
    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left:
            fits = np.flatnonzero(room >= left)
            at = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            n = min(left, int(room[at]))
            out.append((int(doc), start, n, at, capacity - int(room[at])))
            cost[at] += linear * n + quadratic * n * n
            room[at] -= n
            start, left = start + n, left - n
    return out


def packer(path: str, capacity: int, end_id: int, group: int, kept: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The task: whole sequences are cut from long documents at once, the rests are balanced `group` at a time."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        rests: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids

        def crc(ids: np.ndarray) -> int:
            return zlib.crc32(ids.astype("<u4").tobytes())

        def flush() -> list[tuple]:
            nonlocal sequence, rests
            rows = []
            dealt = balance(np.array([len(r[3]) for r in rests], np.int64), capacity)
            for doc, start, n, at, offset in dealt:
                doc_id, base, total, ids = rests[doc]
                rows.append((doc_id, base + start, n, crc(ids[start : start + n]), total, sequence + at, offset))
            sequence += max((d[3] for d in dealt), default=-1) + 1
            rests = []
            return rows

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return out.astype({"doc_id": "Int64"})

        for part in pieces(frames, "text", RUN_CHARS):
            rows = []
            ids, ends = encoder(path, kept).encode(part["text"].tolist())
            for i, doc_id in enumerate(part["doc_id"].astype("Int64").tolist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id))
                whole = len(own) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((None if doc_id is pd.NA else doc_id, start, capacity, crc(own[start : start + capacity]), len(own), sequence, 0))
                    sequence += 1
                if whole < len(own):
                    rests.append((None if doc_id is pd.NA else doc_id, whole, len(own), own[whole:].copy()))
                if len(rests) == group:
                    rows += flush()
            yield frame(rows)
        yield frame(flush())

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, group: int = 8192, kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its ids and end_id. Each
    task packs the documents it reads, with no shuffle: under one capacity of padding for each `group` documents.
    sequence_id holds the task's number in its high bits and isn't gapless. A worker remembers the ids of up to about
    kept_pieces words: fewer take less memory and more time, and give the same rows.

    Null or empty text: the end id alone. Null ids are kept. Repeated rows are packed each. Very long texts fill
    sequences of their own and leave their rest. Empty input: no rows. Further columns aren't read.
    """
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return slim.mapInPandas(packer(tokenizer_path, capacity, end_id, group, kept_pieces), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
