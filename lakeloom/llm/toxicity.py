"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of the weights of its words; a word's weight is that of
the word and of its beginnings. The document's score is the noisy-or of its sentences,
1 - prod(1 - score), and only documents have labels: the gradient of the noisy-or finds out which
sentences carry them. Fitted in numpy on a bounded sample of labelled rows; every document is then
scored over its whole text in one pass without a shuffle, and sentences that are toxic by
themselves are located.

Null text counts as empty; an empty text has the score of a sentence without words. Rows that
repeat give repeated rows, a null doc_id is kept and counts as held out, other columns are not read.
Without labelled rows of both kinds every document gets the score of the prior.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import process_store, slices, slim
from .labels import MAX_EXAMPLES, held_out, sample

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
MARKS = " \t\"'()[]{}<>|*%$&#@^~_-+=/\\.,;:!?«»¿¡…"
#: Slots of the hashed features, and the lengths of the beginnings of a word that are features.
SLOTS, HEADS = 1 << 18, (4, 5, 6)
#: Documents of the sample that a feature must occur in to be learned.
LEAST_DOCUMENTS = 3
#: Word scores remembered in a worker.
MEMORY = 1_000_000


def features(word: str) -> list[int]:
    """The slots of a word: itself, and its beginnings."""
    plain = word.strip(MARKS).lower()
    heads = [f"{plain[:n]}*" for n in HEADS if len(plain) > n]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in [plain, *heads]] if plain else []


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    @property
    def key(self) -> str:
        return f"toxicity:{zlib.crc32(self.weights.tobytes())}:{self.bias}"


@dataclass
class Bags:
    """Labelled documents as bags of sentences: a word number per token, words per sentence, sentences per document.

    `slots` has the features of each word, filled up with -1.
    """

    token: np.ndarray
    words: np.ndarray
    sentences: np.ndarray
    label: np.ndarray
    slots: np.ndarray


def bags(sampled: DataFrame) -> Bags:
    """The bags of a bounded sample (doc_id, text, label). Texts are cut up and hashed by the tasks; packed numbers alone
    reach the driver, about eight bytes a word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            token, sizes, vocabulary = [], [], []
            for text in batch.column("text").to_pylist():
                parts = [part.split() for part in SENTENCE.findall(text) or [""]]
                of = {w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for p in parts for w in p}
                token.append(np.array([of[w] for p in parts for w in p], np.uint64).tobytes())
                sizes.append(np.array([len(p) for p in parts], np.int32).tobytes())
                known = [(h, [*features(w), -1, -1, -1, -1][: 1 + len(HEADS)]) for w, h in of.items()]
                vocabulary.append([{"word": np.uint64(h).astype(np.int64), "slots": f} for h, f in known])
            kind = pa.list_(pa.struct([("word", pa.int64()), ("slots", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "label": batch.column("label"),
                    "token": pa.array(token, pa.binary()),
                    "sizes": pa.array(sizes, pa.binary()),
                    "vocabulary": pa.array(vocabulary, kind),
                }
            )

    schema = "doc_id long, label int, token binary, sizes binary, vocabulary array<struct<word:bigint,slots:array<int>>>"
    cut_up = settle(sampled.repartition("doc_id").mapInArrow(cut, schema), "toxic-sample")
    rows = cut_up.select("doc_id", "label", "token", "sizes").orderBy(F.xxhash64("doc_id"), "doc_id", "token", "label").toArrow()
    words = cut_up.select(F.explode("vocabulary").alias("w")).groupBy("w.word").agg(F.first("w.slots").alias("slots")).toArrow()
    names = words.column("word").to_numpy().view(np.uint64)
    order = np.argsort(names)
    slots = words.column("slots").combine_chunks().flatten().to_numpy().reshape(len(names), 1 + len(HEADS))[order].astype(np.int32)
    sizes = [np.frombuffer(b, np.int32) for b in rows.column("sizes").to_pylist()]
    token = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in rows.column("token").to_pylist())])
    return Bags(
        np.searchsorted(names[order], token).astype(np.int32),
        np.concatenate([np.zeros(0, np.int32), *sizes]),
        np.array([len(s) for s in sizes], np.int32),
        rows.column("label").to_numpy().astype(float),
        slots,
    )


def fit(rows: Bags, rounds: int = 100, rate: float = 1.0, sparse: float = 4e-3, decay: float = 1e-5) -> Model:
    """Noisy-or over sentences, fitted by accelerated proximal gradient on the likelihood of the document labels."""
    label, n_docs, n_words = rows.label, len(rows.label), len(rows.slots)
    if len(np.unique(label)) < 2:
        prior = (label.sum() + 0.5) / (n_docs + 1.0)
        return Model(np.zeros(SLOTS, np.float32), math.log(prior / (1 - prior)))
    document_of = np.repeat(np.arange(n_docs, dtype=np.int32), rows.sentences)
    sentence_of = np.repeat(np.arange(len(rows.words), dtype=np.int32), rows.words)
    token = rows.token
    seen = np.zeros(SLOTS, np.int32)
    ends = np.cumsum(np.bincount(document_of, rows.words, n_docs).astype(np.int64))
    for first, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        here = np.unique(rows.slots[np.unique(token[first:end])])
        seen[here[here >= 0]] += 1
    # The features worth learning, numbered anew.
    kept = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    place = np.full(SLOTS, -1)
    place[kept] = np.arange(len(kept))
    word_of, at = np.nonzero(rows.slots >= 0)
    feature = place[rows.slots[word_of, at]]
    word_of, feature = word_of[feature >= 0], feature[feature >= 0]
    # Both labels weigh the same; a feature's gradient is then the share of documents that ask for it,
    # so the threshold of the proximal step leaves words of a few documents at zero.
    weight = np.where(label > 0, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    w, ahead, bias, momentum = np.zeros(len(kept)), np.zeros(len(kept)), -4.0, 0.0
    for step in range(1, rounds + 1):
        of_word = np.bincount(word_of, ahead[feature], n_words)
        z = np.clip(bias + np.bincount(sentence_of, of_word[token], len(document_of)), -30, 30)
        none = np.bincount(document_of, np.logaddexp(0, z), n_docs)  # -log P(no sentence is toxic)
        slope = weight * np.where(label > 0, -1 / np.expm1(np.maximum(none, 1e-6)), 1.0)
        to_z = slope[document_of] / (1 + np.exp(-z))
        to_word = np.bincount(token, to_z[sentence_of], n_words)
        gradient = np.clip(np.bincount(feature, to_word[word_of], len(kept)), -1, 1)
        stepped = ahead - rate * gradient
        following = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * sparse, 0)
        ahead = following + (step - 1) / (step + 2) * (following - w)
        w = following
        momentum = 0.9 * momentum + float(np.clip(to_z.sum(), -1, 1))
        bias -= 0.3 * momentum
    # The words found are few; fitted again without the threshold, they get their full weight.
    chosen = np.flatnonzero(w > 0)
    new = np.full(len(kept), -1)
    new[chosen] = np.arange(len(chosen))
    word_of, feature = word_of[new[feature] >= 0], new[feature[new[feature] >= 0]]
    telling = np.bincount(word_of, minlength=n_words)[token] > 0
    token, sentence_of = token[telling], sentence_of[telling]
    w = np.append(w[chosen], bias)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 2 * rounds + 1):
        of_word = np.bincount(word_of, w[feature], n_words)
        z = np.clip(w[-1] + np.bincount(sentence_of, of_word[token], len(document_of)), -30, 30)
        none = np.bincount(document_of, np.logaddexp(0, z), n_docs)
        slope = np.where(label > 0, -1 / np.expm1(np.maximum(none, 1e-6)), 1.0) / n_docs
        to_z = slope[document_of] / (1 + np.exp(-z))
        to_word = np.bincount(token, to_z[sentence_of], n_words)
        gradient = np.append(np.bincount(feature, to_word[word_of], len(chosen)) + decay * w[:-1], to_z.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(SLOTS, np.float32)
    weights[kept[chosen]] = w[:-1]
    return Model(weights, float(w[-1]))


class WordScores(dict):
    """The weight of each word as it stands in the text."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        score = self[word] = float(sum(self.weights[f] for f in features(word)))
        return score


def sentence_logits(text: str, scores: WordScores, bias: float) -> list[float]:
    get = scores.__getitem__
    return [bias + sum(map(get, part.split())) for part in SENTENCE.findall(text)] or [bias]


def noisy_or(logits: list[float]) -> float:
    z = np.clip(np.array(logits), -30, 30)
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, and its toxic sentences as (first character, behind the last, score)."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = process_store(model.key, lambda: WordScores(model.weights))
        where = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            out, located = [], []
            for text in batch.column(1).to_pylist():
                logits = sentence_logits(text, scores, model.bias)
                out.append(noisy_or(logits))
                found = []
                if out[-1] >= threshold and text:
                    for z, m in zip(logits, SENTENCE.finditer(text), strict=False):
                        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                        if p >= threshold:
                            found.append({"first": m.start(), "behind": m.end(), "score": p})
                located.append(found)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "score": pa.array(out, pa.float64()), "sentences": pa.array(located, where)}
            )

    schema = "doc_id long, score double, sentences array<struct<first:int,behind:int,score:double>>"
    return slim(docs, id_col, text_col).mapInArrow(rate, schema)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, value: int = 0, limit: int = MAX_EXAMPLES) -> Model:
    """A model from `toxic` of `labels`, without the fold that is held out."""
    return fit(bags(sample(docs, labels, "toxic", modulus, value, limit)))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, value: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, sentences."""
    scored = score(docs, learn(docs, labels, modulus, value), threshold)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, value).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "sentences",
    )


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without the documents the model rejects; the columns stay as they are. No shuffle."""
    names, at = docs.columns, docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = process_store(model.key, lambda: WordScores(model.weights))
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            mask = [noisy_or(sentence_logits(t or "", scores, model.bias)) < threshold for t in texts]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.select(*names).mapInArrow(keep, docs.schema)
