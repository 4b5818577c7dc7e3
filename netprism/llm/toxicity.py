"""Toxicity (8): multiple-instance learning over sentences.

A text is a bag of sentences (cut at ``.``, ``!``, ``?`` and line feeds).  A
sentence's score is a logistic function of its words and of their first 4, 5
and 6 bytes (named by their crc32); a document is toxic if any
sentence is, so its score is a noisy-or with a leak:
1 - (1 - leak) * prod(1 - p(sentence)).  Only document labels are known; the
gradient of the document's likelihood flows back to the sentences, so the same
weights point out the offending ones.  A weight starts at its evidence, how
much more often toxic documents hold it than clean ones at the low end of its confidence, and an L2
penalty holds it there: a word that only toxic documents have tells by itself,
though most of them hold several such words and any one would explain the label.

Training takes at most ``per_class`` labelled documents of either label (the
smallest hashes of their ids; the bound is the parameter) of the training
folds; the classes are weighted back to their shares among all training
labels.  Only their hashed words come to the driver.  Everything is scored:
whole texts, all documents.

Edge cases: a null or empty text has no sentences and scores the leak; a
document with several label rows is toxic if one of them says so; null labels
or ids teach nothing; without any usable label the score is 0; equal texts
get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, id_bucket, kept_names, with_kept

#: The first byte of the word that marks the end of a sentence.
STOP = b"\x01"
_TABLE = bytes((1 if chr(b) in ".!?\n" else 32 if chr(b) in "\x01\"#$%&()*+,-/:;<=>@[\\]^_`{|}~\t\r\x0b\x0c" else b)
               for b in range(256))
SENTENCE = re.compile(rb"[.!?\n]")


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of a text, with ``STOP`` after each sentence."""
    return text.lower().translate(_TABLE).replace(STOP, b" \x01 ").split()


def word_features(word: bytes) -> list[int]:
    """Numbers of the weights of a word: the word itself and its beginnings."""
    return [zlib.crc32(word)] + [zlib.crc32(b"^" + word[:n]) for n in (4, 5, 6) if len(word) >= n]


class _Features(dict):
    """word -> numbers of its weights; none for the end of a sentence."""

    def __init__(self):
        super().__init__({STOP: []})

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
            self[STOP] = []
        k = self[word] = word_features(word)
        return k


class _Weights(dict):
    """word -> its weight in a sentence; not a number for the end of a sentence."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray):
        super().__init__({STOP: math.nan})
        self.weights = dict(zip(numbers.tolist(), weights.tolist(), strict=True))

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
            self[STOP] = math.nan
        w = self[word] = sum([self.weights.get(k, 0.0) for k in word_features(word)])
        return w


def bag(text: bytes, table: _Features) -> tuple[np.ndarray, np.ndarray]:
    """(weight numbers of all words, the sentence of each); only sentences that
    have words count, from 0."""
    words = words_of(text)
    got = [table[w] for w in words]
    place = np.cumsum([w == STOP for w in words])
    size = np.array([len(k) for k in got], np.int64)
    place = np.unique(np.repeat(place, size), return_inverse=True)[1] if len(words) else np.empty(0, np.int64)
    return np.array([x for k in got for x in k], np.uint32), place.astype(np.int32)


def _softplus(z):
    return np.logaddexp(0.0, z)


def _sigmoid(z):
    return np.exp(-np.logaddexp(0.0, -z))


def evidence(seen: np.ndarray, toxic: np.ndarray, z: float) -> np.ndarray:
    """What each weight says by itself: how much more often toxic documents hold it than clean ones, as a
    logarithm and at least 0, with counts at the unfavourable end of their confidence (``z`` standard
    errors of a Poisson count, by the cube-root approximation).  ``seen`` counts the documents of label 0 and 1 with it."""
    clean, t = seen[0] + 1, np.maximum(seen[1], 0.5)
    high = clean * (1 - 1 / (9 * clean) + z / (3 * np.sqrt(clean))) ** 3
    low = t * np.maximum(1 - 1 / (9 * t) - z / (3 * np.sqrt(t)), 0.01) ** 3
    return np.maximum(np.log(low / high) - np.log((toxic.sum() + 1) / ((~toxic).sum() + 1)), 0.0)


def loss(w, b, c, words, sent, doc, toxic, weight, start, hold):
    """(mean negative log-likelihood of the documents plus ``hold`` / 2 times the squared distance of
    ``w`` from ``start``; its derivatives by w, b and c).  ``words`` are numbers of weights, ``sent`` the sentence of each,
    ``doc`` the document of each sentence."""
    z = b + np.bincount(sent, w[words], minlength=len(doc))
    a = np.bincount(doc, _softplus(z), minlength=len(toxic)) + _softplus(c)
    share = weight / weight.sum()
    # likelihood: exp(-a) for label 0, 1 - exp(-a) for label 1
    a = np.clip(a, 1e-9, 500.0)
    value = (share * np.where(toxic, -np.log(-np.expm1(-a)), a)).sum() + hold / 2 * ((w - start) ** 2).sum()
    da = share * np.where(toxic, -1.0 / np.expm1(a), 1.0)
    dz = da[doc] * _sigmoid(z)
    by_word = np.bincount(words, dz[sent], minlength=len(w)) + hold * (w - start)
    return value, by_word, dz.sum(), (da * _sigmoid(c)).sum()


def _fit(bags, toxic, weight, epochs=100, rate=0.05, hold=1e-3, least=4, z=2.25, bias=-8.5):
    """(numbers, their weights, bias, leak) from bags (features, sentences), by Adam on the
    whole sample from the evidence of each weight, which also holds it (an L2 penalty on the distance).
    The bias of a sentence is a parameter: learned, it sinks until only several words together tell.
    No weight falls below 0, so clean words beside a toxic one do not hide it."""
    n_sent = np.array([int(s[-1]) + 1 if len(s) else 0 for _, s in bags])
    first = np.cumsum(n_sent) - n_sent
    # a weight is learned for what occurs in ``least`` documents or more
    single = [np.unique(k) for k, _ in bags]
    used, times = np.unique(np.concatenate(single), return_counts=True)
    used = used[times >= least]
    if not len(used):
        return used, np.zeros(0, np.float32), bias, -3.5
    last = len(used) - 1
    seen = np.zeros((2, len(used)))
    words, sent = [], []
    for (k, s), one, y, f in zip(bags, single, toxic, first.tolist(), strict=True):
        place = np.searchsorted(used, one)
        seen[int(y), place[used[np.minimum(place, last)] == one]] += 1
        place = np.searchsorted(used, k)
        mine = used[np.minimum(place, last)] == k
        words.append(place[mine].astype(np.int32))
        sent.append(s[mine] + np.int32(f))
    words, sent = np.concatenate(words), np.concatenate(sent)
    doc = np.repeat(np.arange(len(bags)), n_sent)
    start = evidence(seen, toxic, z)
    w, c = start.copy(), -3.5
    one, two = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        _, by_word, _, by_c = loss(w, bias, c, words, sent, doc, toxic, weight, start, hold)
        g = np.append(by_word, by_c)
        one = 0.9 * one + 0.1 * g
        two = 0.99 * two + 0.01 * g * g
        move = rate / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-5) * one / (1 - 0.9 ** step)
        w, c = np.maximum(w - move[:-1], 0.0), c - move[-1]
    return used, w.astype(np.float32), bias, float(c)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, held_out: int = 2, folds: int = 4):
    """(sampled labelled ids, {label: rows among all training labels})."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                          & (id_bucket(F.col("doc_id"), folds) != held_out))
    lab = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in lab.groupBy("_toxic").count().collect()}
    sample = None
    for y in (0, 1):
        part = lab.where(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    return sample, counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000):
    """(numbers, weights, bias, leak) as numpy / floats; None if there is nothing to learn from."""
    sample, counts = training_rows(docs, labels, per_class)
    # at most 2 * per_class ids
    chosen = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        table = _Features()
        for b in batches:
            rows = []
            for y, text in zip(b.column(b.schema.get_field_index("_toxic")).to_pylist(),
                               binary_column(b, "text"), strict=True):
                k, s = bag(text, table)
                rows.append({"toxic": y, "k": k.view(np.int32), "s": s})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("toxic", pa.int32()), ("k", pa.list_(pa.int32())), ("s", pa.list_(pa.int32()))]))

    got = chosen.mapInArrow(run, "toxic int, k array<int>, s array<int>").toArrow()
    if not got.num_rows or len(counts) < 2:
        return None
    toxic = got["toxic"].to_numpy() == 1
    if toxic.all() or not toxic.any():
        return None
    weight = np.where(toxic, counts[1] / toxic.sum(), counts[0] / (~toxic).sum())
    bags = [(np.asarray(k.values).view(np.uint32), np.asarray(s.values)) for k, s in zip(got["k"], got["s"], strict=True)]
    order = np.argsort([zlib.crc32(k.tobytes()) for k, _ in bags], kind="stable")  # not the order of arrival
    return _fit([bags[i] for i in order], toxic[order], weight[order])


def score(docs: DataFrame, model, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and the offending sentences (number, score,
    text) of every document; ``keep`` names further columns to carry along, as
    ``_keep0``, ``_keep1`` and so on (their own names may clash with these)."""
    out = "doc_id long, score double, predicted int, offending array<struct<sentence:int,score:double,text:string>>"
    rows, kinds = with_kept(docs, keep)
    handle = docs.sparkSession.sparkContext.broadcast(model)  # what few thousand documents hold, not the corpus
    part = pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())])

    def run(batches):
        fitted = handle.value
        table = None if fitted is None else _Weights(*fitted[:2])
        for b in batches:
            scores, spans = [], []
            for text in binary_column(b, "text"):
                value, found = (0.0, []) if fitted is None else _score(text, fitted, table, threshold)
                scores.append(value)
                spans.append(found)
            arrays = [b.column(0).cast(pa.int64()), pa.array(scores, pa.float64()),
                      pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, pa.list_(part))]
            yield pa.RecordBatch.from_arrays(arrays + [b.column(2 + i) for i in range(len(keep))],
                                             names=["doc_id", "score", "predicted", "offending", *kept_names(keep)])

    return rows.mapInArrow(run, out + kinds)


def _score(text: bytes, fitted, table, threshold):
    bias, leak = fitted[2:]
    words = words_of(text)
    w = np.fromiter(map(table.__getitem__, words), np.float64, len(words))
    stop = np.isnan(w)
    place = np.cumsum(stop)[~stop]
    sums = np.bincount(place, w[~stop])
    kept = np.flatnonzero(np.bincount(place))  # sentences that have words
    z = bias + sums[kept]
    found = []
    p = _sigmoid(z)
    if len(p) and p.max() >= threshold:
        texts = SENTENCE.split(text)
        found = [{"sentence": int(kept[i]), "score": float(p[i]), "text": texts[kept[i]].decode("utf-8", "replace")}
                 for i in np.flatnonzero(p >= threshold)]
    return float(-np.expm1(-(_softplus(z).sum() + _softplus(leak)))), found
