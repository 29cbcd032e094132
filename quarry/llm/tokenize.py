"""Encode whole texts with the tokenizers library, each distinct piece once.

A byte-level BPE never merges over a pre-token's end. Texts are therefore cut at ends that no context can move (before
a single space between two characters that aren't white space, around a lone line feed, between a letter and a stop),
distinct pieces are encoded by the library, and ids are gathered by numpy. The result equals encoding the text at once.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts with these need the slower cut: white space beside white space, or white space other than space and line feed.
ODD = r"\x00|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SAFE = re.compile(r"(?<=\S)(?= \S)")
KEPT_CHARS, KEPT_PIECES = 48, 400_000

RUN_CHARS = 2_000_000  # of texts that are encoded at once

_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, kept: int = KEPT_PIECES) -> PieceEncoder:
    """The worker's encoder for a tokenizer file. It lives on between tasks, so `kept` bounds what an idle worker holds."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].kept = kept
    return _encoders[path]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceEncoder:
    """Strings of special tokens within a text are ordinary text. Memory: at most `kept` pieces are kept."""

    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        from tokenizers import Tokenizer

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = array("I"), array("q"), array("i")

    def _learn(self, new: list[str]) -> list[int]:
        """Encode pieces, and return their numbers in this encoder."""
        spaced: list[str] = []
        rest: list[str] = []
        for p in new:
            (spaced if p.rfind(" ") == 0 and len(p) > 1 else rest).append(p)
        number: dict[str, int] = {}
        runs = [spaced[at : at + 100] for at in range(0, len(spaced), 100)]
        for part, e in zip(runs, self.tokenizer.encode_batch_fast(["".join(part) for part in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            heads = np.flatnonzero(self.opens[ids])
            if len(heads) != len(part) or heads[0]:
                rest += part
                continue
            number.update(zip(part, range(len(self.starts), len(self.starts) + len(part)), strict=True))
            self.starts.frombytes((heads + len(self.ids)).astype(np.int64).tobytes())
            self.lengths.frombytes(np.diff(heads, append=len(ids)).astype(np.int32).tobytes())
            self.ids.frombytes(ids.tobytes())
        self.known.update({p: i for p, i in number.items() if len(p) <= KEPT_CHARS})
        out = dict(number)
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[p] = len(self.starts)
                self.starts.append(len(self.ids))
                self.lengths.append(len(e.ids))
                self.ids.extend(e.ids)
                if len(p) <= KEPT_CHARS:
                    self.known[p] = out[p]
        return [out[p] for p in new]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and the offset of each text's first id with the end as last. Null: as empty."""
        if len(self.known) > self.kept:
            self.clear()
        column = pa.array(["" if t is None else t for t in texts], pa.large_string())
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        plain = column.filter(pa.array(~odd))
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
        marked = pc.replace_substring_regex(marked, r"([a-z])([.,!])", "\\1\x00\\2")
        lists = pc.split_pattern(marked, "\x00")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten() if len(lists) else pa.array([], pa.large_string())
        order = np.flatnonzero(~odd)
        if odd.any():
            cut = [SAFE.split(texts[i]) for i in np.flatnonzero(odd)]
            sizes = np.concatenate([sizes, np.array([len(c) for c in cut], np.int64)])
            flat = pa.concat_arrays([flat.cast(pa.large_string()), pa.array([p for c in cut for p in c], pa.large_string())])
            order = np.concatenate([order, np.flatnonzero(odd)])
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(codes < 0)):
            codes[missing] = self._learn([words[i] for i in missing])
        ids, starts, lengths = np.frombuffer(self.ids, np.uint32).copy(), np.array(self.starts, np.int64), np.array(self.lengths, np.int64)
        at = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        got = ids[spread(starts[at], lengths[at])] if len(at) else np.zeros(0, np.uint32)
        done = np.concatenate([[0], np.cumsum(lengths[at])])
        ends = done[np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
        count = np.diff(ends, prepend=0)
        if odd.any():  # back to the order of the texts
            back = np.argsort(order)
            got, count = got[spread((ends - count)[back], count[back])], count[back]
        return got, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
