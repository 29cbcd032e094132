"""Language identification by a linear-chain conditional random field over words (operator 5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import pieces

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
SEGMENT, CONTEXT = 512, 32
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-case words of letters and marks, parted by single spaces."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " ")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray  # labels x labels, logarithms
    lexicon: list[dict[str, None]]  # the most frequent words of each label in the sample
    lexicon_weights: np.ndarray  # labels x labels: what a word of a label's lexicon says

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of each word and label, each row's largest 0."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        flat, starts = features(words)
        return self.scores(flat, starts, self.listed(words))

    def listed(self, words: list[str]) -> np.ndarray:
        """words x labels: whether the word is in the label's lexicon."""
        return np.array([[w in lex for lex in self.lexicon] for w in words], np.float32).reshape(len(words), len(self.labels))

    def scores(self, flat: np.ndarray, starts: np.ndarray, listed: np.ndarray) -> np.ndarray:
        count = np.diff(starts, append=len(flat))
        out = np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(count)[:, None] + listed @ self.lexicon_weights
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, word by word, and each word's first place in them (each has some).

    The features of a word are the byte n-grams of its UTF-8 between two marks; n-grams with a mark are its affixes.
    """
    raws = [b"\x02" + w.encode() + b"\x03" for w in words]
    raw = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.array([len(r) for r in raws], np.int64))
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(raw))  # bytes from here to the word's end
    table = np.full((len(raw), len(GRAMS)), -1, np.int64)
    rolled = np.zeros(len(raw), np.uint64)
    for k, n in enumerate(GRAMS):
        rolled = rolled[: len(raw) - n + 1] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(n)
        mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        fits = room[: len(rolled)] >= n
        table[: len(rolled), k][fits] = (mixed[fits] >> np.uint64(40)).astype(np.int64) % BUCKETS
    used = table >= 0
    per_byte = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return table[used], per_byte[np.concatenate([[0], ends[:-1]])]


def chain(emissions: np.ndarray, inside: np.ndarray, transitions: np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward. emissions: steps x chains x labels (log), inside: steps x chains. Posteriors, and expected transitions."""
    steps, chains, k = emissions.shape
    e = np.exp(emissions)
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    forward = np.empty_like(e)
    forward[0] = np.where(inside[0][:, None], e[0], 1.0)
    forward[0] /= forward[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (forward[t - 1] @ a) * e[t]
        now /= np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
        forward[t] = np.where(inside[t][:, None], now, forward[t - 1])
    backward = np.ones((chains, k), np.float32)
    posterior = np.empty_like(e)
    pairs = np.zeros((k, k)) if edges else None
    for t in range(steps - 1, -1, -1):
        p = forward[t] * backward
        posterior[t] = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
        if t == 0:
            break
        ahead = e[t] * backward
        if edges:
            joint = forward[t - 1][:, :, None] * a[None] * ahead[:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)
            pairs += joint[inside[t]].sum(axis=0)
        now = ahead @ a.T
        now /= np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
        backward = np.where(inside[t][:, None], now, backward)
    return posterior, pairs


def sample(docs: DataFrame, per_language: int, words: int) -> list[tuple[str, list[str]]]:
    """At most per_language labelled training documents of each language, by hash of the id, and of each a run of words."""
    open_rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in open_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * per_language / n))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    drawn = open_rows.withColumn("unit", unit).filter(F.col("unit") < F.element_at(share, F.col("lang")))
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("unit", "doc_id", "text"))).filter(F.col("place") <= per_language)
    split = F.split(letters(F.col("text")), " ")
    first = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size(split) - words, F.lit(0)) + 1)
    rows = ranked.select("lang", "unit", "doc_id", F.slice(split, first.cast("int"), words).alias("words")).collect()
    return [(r["lang"], list(r["words"])) for r in sorted(rows, key=lambda r: (r["lang"], r["unit"], str(r["doc_id"]), r["words"]))]


def fit(labelled: list[tuple[str, list[str]]], rounds: int = 60, listed: int = 200, length: int = 64, seed: int = 7) -> Model | None:
    """Train on chains spliced from runs of documents in different languages, so that switches are seen and learned."""
    if not labelled:
        return None
    labels = sorted({lang for lang, _ in labelled})
    k, rng = len(labels), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(labels)}
    lexicon: list[dict[str, None]] = []
    for lang in labels:
        found, count = np.unique(np.array([w for x, ws in labelled if x == lang for w in ws], object).astype(str), return_counts=True)
        lexicon.append(dict.fromkeys(found[np.argsort(-count, kind="stable")[:listed]].tolist()))
    runs = []
    for lang, ws in labelled:
        at = 0
        while at < len(ws):
            n = int(rng.integers(6, 40))
            runs.append((number[lang], ws[at : at + n]))
            at += n
    flat_words, flat_labels = [], []
    for i in rng.permutation(len(runs)):
        flat_words += runs[i][1]
        flat_labels += [runs[i][0]] * len(runs[i][1])
    coded = pa.array(flat_words, pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    chains = -(-len(flat_words) // length)
    code, label = np.zeros(chains * length, np.int64), np.zeros(chains * length, np.int64)
    code[: len(flat_words)], label[: len(flat_words)] = coded.indices.to_numpy(), flat_labels
    inside = np.arange(chains * length) < len(flat_words)
    code, label, inside = code.reshape(chains, length).T, label.reshape(chains, length).T, inside.reshape(chains, length).T

    model = Model(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), lexicon, np.zeros((k, k), np.float32))
    flat, starts = features(words)
    marks = model.listed(words)
    scale = 1 / np.sqrt(np.diff(starts, append=len(flat)))
    of_word = np.repeat(np.arange(len(words)), np.diff(starts, append=len(flat)))
    gold = np.eye(k, dtype=np.float32)[label]
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (label[:-1][inside[1:]], label[1:][inside[1:]]), 1)
    parts = [model.weights, model.lexicon_weights, model.transitions]
    squares = [np.full(p.shape, 1e-6) for p in parts]
    for _ in range(rounds):
        scores = model.scores(flat, starts, marks)
        posterior, pairs = chain(scores[code], inside, model.transitions, edges=True)
        error = ((gold - posterior) * inside[:, :, None]).reshape(-1, k)
        by_word = np.stack([np.bincount(code.ravel(), error[:, j], len(words)) for j in range(k)], axis=1)
        scaled = (by_word * scale[:, None])[of_word]
        steps = [np.stack([np.bincount(flat, scaled[:, j], BUCKETS) for j in range(k)], axis=1), marks.T @ by_word, true_pairs - pairs]
        for p, square, step in zip(parts, squares, steps, strict=True):
            step = step - 0.1 * p
            square += step**2
            p += (0.3 * step / np.sqrt(square)).astype(np.float32)
    return model


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Label and score (its mean posterior over all words) of texts of letters; und and 0 for those without words.

    Chains over SEGMENT words are cut, and each part is read with CONTEXT words of its neighbours on either side.
    """
    column = pa.array(texts, pa.large_string())
    lists = pc.split_pattern(column, " ")
    count = np.where(np.array([len(t) for t in texts]) > 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = lists.flatten()
    flat = flat.filter(pc.not_equal(flat, ""))
    k = len(model.labels)
    if not len(flat):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    scores = model.emissions(coded.dictionary.to_pylist())
    begin = np.cumsum(count) - count
    parts = -(-count // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    core = begin[doc] + nth * SEGMENT
    core_end = np.minimum(core + SEGMENT, begin[doc] + count[doc])
    low, high = np.maximum(core - CONTEXT, begin[doc]), np.minimum(core_end + CONTEXT, begin[doc] + count[doc])
    total = np.zeros((len(texts), k))
    order = np.argsort(high - low, kind="stable")
    for chosen in np.array_split(order, -(-len(order) // 256)):
        steps = int((high - low)[chosen].max())
        place = low[chosen][None, :] + np.arange(steps)[:, None]
        inside = place < high[chosen][None, :]
        posterior, _ = chain(scores[codes[np.minimum(place, len(codes) - 1)]], inside, model.transitions)
        own = (place >= core[chosen]) & (place < core_end[chosen])
        np.add.at(total, doc[chosen], (posterior * own[:, :, None]).sum(axis=0))
    mean = total / np.maximum(count, 1)[:, None]
    best = mean.argmax(axis=1)
    return [model.labels[b] if n else UNKNOWN for b, n in zip(best, count, strict=True)], np.where(count > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)


def predictor(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, "text"):
            lang, score = predict(model, part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": lang, "score": score})

    return run


def identify_languages(docs: DataFrame, per_language: int = 400, words: int = 160) -> DataFrame:
    """Predict the language of every whole text; returns doc_id, held_out, lang_pred, score for each row.

    Words are labelled by forward-backward; a text gets the label with the largest mean posterior over its words, which
    is its score. The field learns from at most per_language documents of each language and `words` words of each,
    among rows with text and lang whose crc32(doc_id as text) mod 5 isn't 0. Prediction reads the text only.

    Null text or one without a letter: `und`, score 0. Null doc_id: as the empty text for the fold. Repeated rows get
    equal predictions. Long texts are read whole. No labelled row: all `und`. Empty input: no rows. Further columns
    aren't read.
    """
    model = fit(sample(docs, per_language, words))
    spoken = F.when(F.col("text").rlike(r"\p{L}"), letters(F.col("text"))).otherwise(F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), spoken.alias("text"))
    if model is None:
        return slim.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return slim.mapInPandas(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.4, per_language: int = 400, words: int = 160) -> DataFrame:
    """docs whose language was identified with a score of `least` or more, with all their columns.

    Without a labelled row to learn from there is no score: texts with a letter stay, null texts and others go.
    """
    model = fit(sample(docs, per_language, words))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        # in runs of bounded size: a batch has a fixed number of rows, however long
        parts = [predict(model, part["text"].tolist())[1] for part in pieces(iter([texts.to_frame("text")]), "text")]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    spoken = F.when(F.col("text").rlike(r"\p{L}"), letters(F.col("text"))).otherwise(F.lit(""))
    return docs.filter(score(spoken) >= least)
