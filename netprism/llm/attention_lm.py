"""LM scoring (6): a causal self-attention model on sub-word ids, in numpy.

Words (white space tokens, A-Z lower-cased) are written as sub-word ids of a
public vocabulary; an end id closes each text.  The model gives P(id | context)
= P(class | context) * P(id | class, class before): the most frequent ids are
classes of their own, the others share classes by frequency and by whether
they end a word.  An attention head over the context, with embeddings of the ids
and a learned bias per distance, weighs ``EXPERTS`` bigram tables of the classes;
each table is the smoothed one of the whole training corpus with learned changes.
So a normalised probability costs a few products per id, not one per class.  The
weights are drawn anew at every id, from all ids before it in its window.  An id's
embeddings start as those of its class.  Ids within a class are counted after each class.  Texts are cut into blocks of ``BLOCK`` ids; a window is a block
with the one before it, so windows overlap by half and each id is scored
once, in a batch of masked attention products.

What is learned: word counts, id counts and counts of (class, id after it) from
every word of every training document; the attention weights by Adam on every
training block, each task on its own texts, weights averaged by tokens after
each of ``rounds`` passes.  All of it grows with the input.

Word counts never meet in one place.  Rows of the table are numbered chunks
of the scan; a chunk's distinct words are joined with the global counts (and
the words' ids, found once per distinct word) on Spark, and each chunk's
dictionary is written under its own name in the shared folder, where the
tasks that scan the chunk again read it.  That second scan leaves each text's
ids and base score; training and scoring read only those, and cut the windows
as they go.

Edge cases: a null text is an empty one (only the end); a null id is held out
like crc32 of nothing; repeated rows are scored alike; without training rows
all counts are 0 and the model falls back to its smoothing; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import scratch_path
from .common import binary_column, filesystem, id_bucket, stored
from .subword import encoder

#: Ids of a block (a window has two blocks), classes, width of the head, tables that it weighs.
BLOCK, HEAD, BINS, WIDTH, EXPERTS = 32, 160, 16, 8, 8
#: Rows of the table that share a dictionary.
CHUNK_ROWS = 2048
SMOOTH = 0.1
#: Weight of the less specific distribution when counts are smoothed with it.
BACKOFF = 4.0
#: Logits of no larger size are exponentiated as they are: their sums stay within single precision.
SAFE = 60.0
#: Windows whose attention is worked on at once, so that its weights stay in the processor's cache.
PART = 128


@dataclass
class Classes:
    """``of[id]`` the class of each id (the end id is the last one), ``log_in``
    the log probability of the id within its class, ``n`` their number."""

    of: np.ndarray
    log_in: np.ndarray
    n: int


def make_classes(counts: np.ndarray, ends_word: np.ndarray) -> Classes:
    """The ``HEAD`` most frequent ids alone, the rest by 2 x ``BINS`` bins of
    equal mass, the end id (last) alone."""
    ids = len(counts) - 1
    order = np.argsort(-counts[:ids], kind="stable")
    of = np.zeros(ids + 1, np.int32)
    of[order[:HEAD]] = np.arange(min(HEAD, ids))
    tail = order[HEAD:]
    mass = np.cumsum(counts[tail] + 1e-3)
    bin_ = np.minimum((mass / max(mass[-1], 1e-9) * BINS).astype(np.int64), BINS - 1) if len(tail) else mass.astype(int)
    of[tail] = HEAD + 2 * bin_ + ends_word[tail]
    n = HEAD + 2 * BINS + 1
    of[ids] = n - 1
    total = np.bincount(of, counts + SMOOTH, minlength=n)
    return Classes(of, np.log((counts + SMOOTH) / total[of]), n)


def input_classes(classes: Classes) -> np.ndarray:
    """The class of each id, of the begin mark and of padding; last, for no target (-1), -1."""
    return np.concatenate([classes.of, [classes.n, classes.n + 1, -1]]).astype(np.int32)


def start_weights(n: int, seed: int = 11, of: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Embeddings of the inputs, the last two the begin mark and padding (without
    ``of``, their classes, the inputs are the n classes); gates; changes of each
    expert's logits by class, and by class before and class."""
    rng = np.random.default_rng(seed)
    table = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    rows = slice(None) if of is None else of[:-1]
    return {"q": table(n + 2, WIDTH)[rows], "k": table(n + 2, WIDTH)[rows], "v": table(n + 2, WIDTH)[rows], "g": table(WIDTH, EXPERTS),
            "b": np.zeros(EXPERTS, np.float32), "r": np.zeros(2 * BLOCK, np.float32),
            "u": table(EXPERTS, 1, n), "d": np.zeros((EXPERTS, n + 2, n), np.float32)}


_DISTANCE = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_SEEN = _DISTANCE >= 0
#: Weights with a row for each input.
_ROWS = ("q", "k", "v")


def attend(w, inputs: np.ndarray, room: np.ndarray | None = None):
    """Queries of the second half of each window, one per position, over what is
    before: (scaled q, k, v and a column of ones, weights, sums, result).  The weights
    (kept in ``room``) are not divided by their sums; the result is."""
    kind = w["q"].dtype
    q, k = w["q"].take(inputs[:, BLOCK:], axis=0), w["k"].take(inputs, axis=0)
    q *= kind.type(1 / math.sqrt(WIDTH))
    v = np.hstack([w["v"], np.ones((len(w["v"]), 1), kind)]).take(inputs, axis=0)
    weights = np.empty((len(inputs), *_SEEN.shape), kind) if room is None else room
    h = np.empty((*q.shape[:2], WIDTH + 1), kind)
    none = inputs[:, 0] == len(w["q"]) - 1  # first blocks of texts: padding before them
    bias = w["r"][np.maximum(_DISTANCE, 0)]
    most, factor = SAFE - np.abs(bias).max(), np.exp(bias) * _SEEN
    for i in range(0, len(inputs), PART):
        at = slice(i, i + PART)
        a = weights[at]
        np.matmul(q[at], k[at].transpose(0, 2, 1), out=a)
        if max(a.max(), -a.min()) < most:
            np.exp(a, out=a)
            a *= factor
            a[none[at], :, :BLOCK] = 0
        else:
            a += np.where(_SEEN, bias, kind.type(-1e9))
            a[none[at], :, :BLOCK] = -1e9
            a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
        np.matmul(a, v[at], out=h[at])
    return q, k, v, weights, h[:, :, WIDTH:], h[:, :, :WIDTH] / h[:, :, WIDTH:]


def gates(w, h: np.ndarray) -> np.ndarray:
    """The experts' shares (rows) for each position (row of ``h``)."""
    g = w["g"].T @ h.reshape(-1, WIDTH).T
    g += w["b"][:, None]
    g -= g.max(axis=0)
    np.exp(g, out=g)
    g /= g.sum(axis=0)
    return g


def _exp_tables(w, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each expert's P(class | class before) before division by its sums, the sums)."""
    t = bigram + w["u"]
    t += w["d"]
    if max(t.max(), -t.min()) > SAFE:
        t -= t.max(axis=2, keepdims=True)
    np.exp(t, out=t)
    return t, np.matmul(t, np.ones(t.shape[2], t.dtype))


def expert_tables(w, bigram: np.ndarray) -> np.ndarray:
    """P(class | class before) of each expert: (experts, classes + 2, classes)."""
    t, total = _exp_tables(w, bigram)
    t /= total[:, :, None]
    return t


def by_pair(tables: np.ndarray) -> np.ndarray:
    """The experts' (rows) probabilities of each pair (class before, class)."""
    return tables.reshape(len(tables), -1)


def _before(inputs: np.ndarray, of: np.ndarray | None) -> np.ndarray:
    """The class before each target."""
    own = inputs[:, BLOCK:].ravel()
    return own if of is None else of[own]


def log_probabilities(w, pairs: np.ndarray, inputs: np.ndarray, targets: np.ndarray, of: np.ndarray | None = None,
                      room: np.ndarray | None = None) -> np.ndarray:
    """Natural log P(class) of each target class (windows x BLOCK; 0 where the
    target is -1); ``of`` has the inputs' classes, if they are ids."""
    g = gates(w, attend(w, inputs, room)[5])
    t = targets.ravel()
    g *= pairs.take(_before(inputs, of) * w["u"].shape[2] + np.maximum(t, 0), axis=1)
    out = np.log(g.sum(axis=0))
    out[t < 0] = 0
    return out.reshape(targets.shape)


def _sums(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``x`` added up by ``at``, column by column: each column's sums stay in the processor's cache."""
    out = np.zeros((x.shape[1], size))
    for own, column in zip(out, x.T.astype(np.float64, order="C"), strict=True):
        np.add.at(own, at, column)
    return out.T


def gradients(w, bigram, inputs, targets, of: np.ndarray | None = None, room=(None, None)) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood; those of embeddings for ``rows`` only, the inputs that occur.
    ``room``: two arrays for the weights of attention and their gradients."""
    q, k, v, a, sums, h = attend(w, inputs, room[0])
    g = gates(w, h)
    n = w["u"].shape[2]
    t = targets.ravel()
    real = t >= 0
    before = _before(inputs, of).astype(np.int64)
    at_pair = before * n + np.maximum(t, 0)
    d, total = _exp_tables(w, bigram)
    r = d.reshape(EXPERTS, -1).take(at_pair, axis=1)
    r *= g
    r /= total.take(before, axis=1)
    scale = real * (1 / max(int(real.sum()), 1))
    r *= (scale / r.sum(axis=0)).astype(r.dtype)
    g *= scale.astype(r.dtype)
    g -= r
    dh = (g.T @ w["g"].T).reshape(h.shape)
    # each expert's rows: expected minus observed
    d *= (_sums(before, r.T, n + 2).T / total).astype(d.dtype)[:, :, None]
    for own, share in zip(d.reshape(EXPERTS, -1), r, strict=True):
        np.subtract.at(own, at_pair, share)
    out = {"g": h.reshape(-1, WIDTH).T @ g.T, "b": g.sum(axis=1), "d": d, "u": np.matmul(np.ones((1, n + 2), d.dtype), d)}
    # a column for the ones beside v: what the division by the sums adds
    back = np.empty((*h.shape[:2], WIDTH + 1), h.dtype)
    np.divide(dh, sums, out=back[:, :, :WIDTH])
    np.negative(np.einsum("ijk,ijk->ij", back[:, :, :WIDTH], h), out=back[:, :, WIDTH])
    dq, dk, dv = np.empty_like(q), np.empty_like(k), np.empty_like(k)
    by = 0
    for i in range(0, len(inputs), PART):
        own = slice(i, i + PART)
        da = np.matmul(back[own], v[own].transpose(0, 2, 1), out=None if room[1] is None else room[1][:len(q[own])])
        da *= a[own]
        np.matmul(da, k[own], out=dq[own])
        np.matmul(da.transpose(0, 2, 1), q[own], out=dk[own])
        np.matmul(a[own].transpose(0, 2, 1), back[own, :, :WIDTH], out=dv[own])
        by = by + np.ones(len(da), da.dtype) @ da.reshape(len(da), -1)
    dq *= q.dtype.type(1 / math.sqrt(WIDTH))
    size = len(w["q"])
    there = np.zeros(size, bool)
    there[inputs] = True
    there[size - 1] = False  # padding learns nothing
    rows = np.flatnonzero(there)
    place = np.full(size, len(rows))
    place[rows] = np.arange(len(rows))
    at = place[inputs]
    for name, to, x in (("q", at[:, BLOCK:], dq), ("k", at, dk), ("v", at, dv)):
        x = x.view(np.result_type(x, np.complex64))  # two columns are added up as one complex number
        to, found = to.ravel(), np.zeros((WIDTH // 2, len(rows) + 1), x.dtype)
        for i, own in enumerate(found):
            np.add.at(own, to, x[:, :, i].ravel())
        out[name] = np.ascontiguousarray(found[:, :-1].T).view(dq.dtype)
    out["r"] = np.bincount(_DISTANCE[_SEEN], by.reshape(_SEEN.shape)[_SEEN], minlength=2 * BLOCK).astype(by.dtype)
    return {"rows": rows} | out


def _adam(x, g, m, s, step: int, rate: float) -> None:
    """One step in place; ``m`` and ``s`` are 10 and 100 times Adam's moments, ``g`` is used up."""
    spread = math.sqrt(0.01 / (1 - 0.99 ** step))
    m *= np.float32(0.9)
    m += g
    s *= np.float32(0.99)
    g *= g
    s += g
    np.sqrt(s, out=g)
    g += np.float32(1e-6 / spread)
    np.divide(m, g, out=g)
    g *= np.float32(rate * 0.1 / (1 - 0.9 ** step) / spread)
    x -= g


def start_state(w) -> dict:
    """Weights and moments for ``steps``."""
    whole = {k: x.copy() for k, x in w.items() if k not in _ROWS}
    # an input's embeddings and their moments lie side by side
    rows = np.zeros((len(w["q"]), 3, len(_ROWS), WIDTH), w["q"].dtype)
    rows[:, 0] = np.stack([w[k] for k in _ROWS], axis=1)
    return {"whole": whole, "first": {k: np.zeros_like(x) for k, x in whole.items()},
            "second": {k: np.zeros_like(x) for k, x in whole.items()}, "rows": rows, "steps": 0}


def weights_of(state) -> dict[str, np.ndarray]:
    return {k: x.copy() for k, x in state["whole"].items()} | {k: state["rows"][:, 0, i].copy() for i, k in enumerate(_ROWS)}


def steps(state, bigram, inputs, targets, rate: float, batch: int = 256, of: np.ndarray | None = None) -> None:
    """One pass of Adam over the windows, in their order.  A step moves the
    embeddings of the inputs that occur in it."""
    table, whole = state["rows"], state["whole"]
    of = np.arange(len(table)) if of is None else of
    room = np.empty((2, min(batch, len(inputs)), *_SEEN.shape), table.dtype)
    place = np.empty(len(table), np.int64)
    for i in range(0, len(inputs), batch):
        state["steps"] = step = state["steps"] + 1
        x = inputs[i:i + batch]
        there = np.zeros(len(table), bool)
        there[x] = True
        there[-1] = True  # padding stays the last row
        rows = np.flatnonzero(there)
        place[rows] = np.arange(len(rows))
        own = table.take(rows, axis=0)
        w = whole | {k: np.ascontiguousarray(own[:, 0, j]) for j, k in enumerate(_ROWS)}
        g = gradients(w, bigram, place.take(x), targets[i:i + batch], of.take(rows), room[:, :len(x)])
        for k, x in whole.items():
            parts = (x, g[k], state["first"][k], state["second"][k])
            for part in zip(*parts, strict=True) if x.ndim == 3 else [parts]:  # a part stays in the processor's cache
                _adam(*part, step, rate)
        now, first, second = (np.ascontiguousarray(own[:-1, j]) for j in range(3))
        _adam(now, np.stack([g[k] for k in _ROWS], axis=1), first, second, step, rate)
        table[rows[:-1]] = np.stack([now, first, second], axis=1)


def descend(w, bigram, inputs, targets, rate: float = 0.02, batch: int = 256, state: dict | None = None,
            of: np.ndarray | None = None):
    """``steps`` from weights w; changed weights.  ``state`` (empty at first)
    carries moments and steps to the next call."""
    state = {} if state is None else state
    moments = dict(state)
    state |= start_state(w)
    if moments:
        state["rows"][:, 1:] = moments["rows"][:, 1:]
        state |= {k: moments[k] for k in ("first", "second", "steps")}
    steps(state, bigram, inputs, targets, rate, batch, of)
    return weights_of(state)


def block_numbers(n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each block, its number in the text)."""
    blocks = -(-n_ids // BLOCK)
    text = np.repeat(np.arange(len(n_ids)), blocks)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)


def windows(classes: np.ndarray, n_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, text of each window) of texts whose classes (or ids, of
    n) lie end to end, ``n_ids`` of each."""
    text, nth = block_numbers(n_ids)
    first = np.searchsorted(text, np.arange(len(n_ids))) * BLOCK
    # each id's place when the blocks lie end to end; the input of a place is the class before it
    place = np.arange(len(classes)) + np.repeat(first - np.cumsum(n_ids) + n_ids, n_ids)
    targets, own = np.full(len(text) * BLOCK, -1, np.int32), np.full(len(text) * BLOCK, n + 1, np.int32)
    targets[place] = classes
    own[place[1:]] = classes[:-1]
    own[first[n_ids > 0]] = n
    own = own.reshape(-1, BLOCK)
    inputs = np.empty((len(text), 2 * BLOCK), np.int32)
    inputs[:, BLOCK:] = own
    inputs[1:, :BLOCK] = own[:-1]
    inputs[nth == 0, :BLOCK] = n + 1
    return inputs, targets.reshape(-1, BLOCK), text


class Dictionary:
    """A chunk's words: number, training count, and ids end to end.  A word may
    be listed more than once (its rows are equal)."""

    def __init__(self, base: str, chunk: int):
        import pyarrow.dataset as ds

        store, folder = filesystem(f"{base}/chunk={chunk}")
        t = ds.dataset(folder, filesystem=store, format="parquet").to_table(columns=["word", "n", "ids"]).combine_chunks()
        self.number = dict(zip(t["word"].to_pylist(), range(t.num_rows), strict=True))
        self.count = t["n"].to_numpy()
        ids = pa.concat_arrays(t["ids"].chunks).cast(pa.large_binary()) if t.num_rows else pa.array([], pa.large_binary())
        self.start = np.frombuffer(ids.buffers()[1], "<i8")[:t.num_rows + 1] // 2 if t.num_rows else np.zeros(1, np.int64)
        self.flat = np.frombuffer(ids.buffers()[2], "<u2") if t.num_rows else np.empty(0, "<u2")
        self.length = np.diff(self.start)
        self.start = self.start[:-1]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers end to end, words of each text)."""
        split = [t.lower().split() for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int32, int(n.sum())), n

    def ids(self, numbers: np.ndarray, n_words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, ids of each text)."""
        length = self.length[numbers]
        total = np.concatenate([[0], np.cumsum(length)])
        upto = np.cumsum(n_words)
        n_ids = total[upto] - total[upto - n_words]
        place = np.repeat(self.start[numbers] - total[:-1], length) + np.arange(int(total[-1]))
        out = np.full(len(place) + len(n_ids), end, np.int32)
        kept = np.arange(len(place)) + np.repeat(np.arange(len(n_ids)), n_ids)
        out[kept] = self.flat[place]
        return out, n_ids + 1


def count_up(table: np.ndarray, at: np.ndarray) -> None:
    """Adds 1 to ``table[i]`` for each i; numbers of other kinds than numpy's own are 20 times slower."""
    np.add.at(table, at.astype(np.intp, copy=False), table.dtype.type(1))


def class_before(classes: np.ndarray, n_ids: np.ndarray, n: int) -> np.ndarray:
    """The class before each id; the begin mark n at the start of each text."""
    out = np.empty_like(classes)
    out[1:] = classes[:-1]
    out[np.cumsum(n_ids) - n_ids] = n
    return out


class Within:
    """log P(id | its class, class before it), from counts per class and id."""

    def __init__(self, classes: Classes, keys: np.ndarray, counts: np.ndarray):
        ids = len(classes.of)
        self.classes = classes
        mass = np.zeros((classes.n + 2) * classes.n)
        np.add.at(mass, keys // ids * classes.n + classes.of[keys % ids], counts)
        self.mass = mass.reshape(classes.n + 2, classes.n)
        seen = np.unique(keys % ids)
        self.column = np.full(ids, -1, np.int32)
        self.column[seen] = np.arange(len(seen))
        of, prior = classes.of[seen], BACKOFF * np.exp(classes.log_in[seen])
        self.table = np.empty((classes.n + 2, len(seen)), np.float32)
        order = np.argsort(keys // ids, kind="stable")
        parts = np.split(order, np.searchsorted((keys // ids)[order], np.arange(1, classes.n + 2)))
        for i, own in enumerate(parts):  # row by row: the whole in doubles is several times as large
            found = np.zeros(len(seen))
            found[self.column[keys[own] % ids]] = counts[own]
            self.table[i] = np.log((found + prior) / (self.mass[i, of] + BACKOFF))

    def bigram(self) -> np.ndarray:
        """Smoothed log P(class | class before)."""
        share = (self.mass.sum(axis=0) + SMOOTH) / (self.mass.sum() + SMOOTH * self.classes.n)
        return np.log((self.mass + BACKOFF * share) / (self.mass.sum(axis=1, keepdims=True) + BACKOFF)).astype(np.float32)

    def logs(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = self.column[ids]
        new = at < 0
        if not new.any():
            return self.table[before, at]
        out = np.empty(len(ids), np.float32)
        out[~new] = self.table[before[~new], at[~new]]
        rare = ids[new]
        out[new] = (math.log(BACKOFF) + self.classes.log_in[rare]
                    - np.log(self.mass[before[new], self.classes.of[rare]] + BACKOFF))
        return out


def _pieces(batch, most: int = 500_000):
    """(chunk, doc ids, trained on?, texts) of parts of a batch with about ``most`` bytes of text."""
    names = batch.schema.names
    col = {c: batch.column(names.index(c)).to_pylist() for c in ("chunk", "doc_id", "train")}
    texts = binary_column(batch, "text")
    for chunk, at in groupby(range(batch.num_rows), col["chunk"].__getitem__):
        part, size = [], 0
        for i in at:
            part.append(i)
            size += len(texts[i])
            if size >= most:
                yield chunk, [col["doc_id"][k] for k in part], [col["train"][k] for k in part], [texts[k] for k in part]
                part, size = [], 0
        if part:
            yield chunk, [col["doc_id"][k] for k in part], [col["train"][k] for k in part], [texts[k] for k in part]


def _chunked(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, text, train and chunk: rows that lie together in a file share one."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs.select("doc_id", "text"), "scored-texts")
    chunk = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / CHUNK_ROWS))
    return docs.select("doc_id", "text", (id_bucket(F.col("doc_id"), folds) != held_out).alias("train"),
                       chunk.alias("chunk"))


def _chunk_words(rows: DataFrame) -> DataFrame:
    """(chunk, word, n): distinct words of each chunk, n in training documents."""
    def run(batches):
        held, seen = None, Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), held, np.int64)), pa.array(list(seen), pa.binary()),
                 pa.array(list(seen.values()), pa.int64())], names=["chunk", "word", "n"])

        for b in batches:
            for chunk, _, train, texts in _pieces(b):
                if chunk != held and seen:
                    yield flush()
                    seen = Counter()
                held = chunk
                other = []
                for t, learn in zip(texts, train, strict=True):
                    if learn:
                        seen.update(t.lower().split())
                    else:
                        other.append(t)
                for t in other:
                    seen.update(dict.fromkeys(t.lower().split(), 0))
                if len(seen) > 250_000:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()

    return rows.mapInArrow(run, "chunk long, word binary, n long")


def _word_ids(words: DataFrame, tokenizer: str) -> DataFrame:
    """words(word, n) with their sub-word ids."""
    def run(batches):
        make = encoder("word", tokenizer, 200_000)  # distinct words: few pieces come again
        for b in batches:
            ids = [make.encoded(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())],
                                             names=["word", "n", "ids"])

    return words.mapInArrow(run, "word binary, n long, ids binary")


def _id_counts(words: DataFrame, n_ids: int) -> np.ndarray:
    """How often each sub-word id occurs in the training words."""
    def run(batches):
        total = np.zeros(n_ids)
        for b in batches:
            ids = b.column(1).to_pylist()
            flat = np.frombuffer(b"".join(ids), "<u2")
            total += np.bincount(flat, np.repeat(b.column(0).to_numpy(), [len(x) // 2 for x in ids]), minlength=n_ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = words.select("n", "ids").mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_ids)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def _digest(rows: DataFrame, base: str, classes: Classes, trained: int, floor: float):
    """(texts, within): doc_id, held_out, n_tokens, n_known, base_score and ids of
    every text; counts of ids after classes."""
    n, ids = classes.n, len(classes.of)
    end_base = math.log10((trained + 0.1) / floor)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("ids", pa.binary()),
                        ("key", pa.int64()), ("n", pa.int64())])

    def part(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                                           for f in schema], schema=schema)

    def run(batches):
        table = np.zeros((n + 2) * ids, np.int32)
        held, words, plain = None, None, None
        for b in batches:
            for chunk, doc_ids, train, texts in _pieces(b):
                if chunk != held:
                    held, words = chunk, _dictionary(base, chunk, texts)
                    plain = np.log10((words.count + 0.1) / floor)
                numbers, n_words = words.texts(texts)
                owner = np.repeat(np.arange(len(texts)), n_words)
                got, n_ids = words.ids(numbers, n_words, ids - 1)
                stop = np.cumsum(n_ids) * 2
                raw = got.astype("<u2").tobytes()
                yield part(len(texts), doc_id=doc_ids, held_out=[not t for t in train], n_tokens=n_words + 1,
                           n_known=np.bincount(owner, words.count[numbers] > 0, minlength=len(texts)).astype(np.int64) + (trained > 0),
                           base_score=np.bincount(owner, plain[numbers], minlength=len(texts)) + end_base,
                           ids=[raw[e - 2 * k:e] for e, k in zip(stop.tolist(), n_ids.tolist(), strict=True)])
                learn = np.array(train)
                own = classes.of[got]
                keys = class_before(own, n_ids, n).astype(np.int64) * ids + got
                count_up(table, keys if learn.all() else keys[np.repeat(learn, n_ids)])
        at = np.flatnonzero(table)
        for i in range(0, len(at), 10_000):
            some = at[i:i + 10_000]
            yield part(len(some), key=some, n=table[some].astype(np.int64))

    made = stored(rows.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary,"
        " key long, n long"), "digests")
    # at most (classes + 1) * ids rows, of which few occur
    got = made.where(F.col("n").isNotNull()).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    within = Within(classes, got["key"].to_numpy(), got["n"].to_numpy())
    texts = made.where(F.col("ids").isNotNull()).select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids")
    return texts, within


def _parts(ids: list[bytes], most: int = 200_000):
    """(first, behind the last, ids end to end, ids of each) of parts of a list of texts with about ``most`` ids."""
    size = np.array([len(x) // 2 for x in ids], np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
        yield lo, hi, np.frombuffer(b"".join(ids[lo:hi]), "<u2").astype(np.int32), size[lo:hi]


_NAMES = ("q", "k", "v", "g", "b", "r", "u", "d")


def _train(texts: DataFrame, bigram: np.ndarray, classes: Classes, rounds: int) -> tuple[dict[str, np.ndarray], int]:
    """(weights, ids that each pass trained on): ``rounds`` passes of Adam over
    every block of ``texts(ids)``, each partition on its own, weights averaged by tokens."""
    of, n_ids = input_classes(classes), len(classes.of)
    weights = start_weights(classes.n, of=of)
    shapes = {k: x.shape for k, x in weights.items()}
    trained = 0
    for turn in range(rounds):
        now = weights

        def run(batches, now=now, turn=turn):
            state, tokens = start_state(now), 0
            mix = np.random.default_rng(turn)
            for b in batches:
                for _, _, got, size in _parts(b.column(0).to_pylist()):
                    x, y, _ = windows(got, size, n_ids)
                    order = mix.permutation(len(x))
                    steps(state, bigram, x[order], of[y[order]], rate=0.03 / (1 + turn), of=of)
                    tokens += len(got)
            if tokens:
                # changes, as singles: half the bytes, and what no text touched is 0 and packs well
                w = weights_of(state)
                flat = np.concatenate([(w[k] - now[k]).ravel() for k in _NAMES]) * np.float32(tokens)
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()]), pa.array([tokens])], names=["w", "tokens"])

        def add(batches):
            total, tokens = None, 0
            for b in batches:
                for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(w, np.float32).astype(np.float64)
                    total, tokens = x if total is None else total + x, tokens + t
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()]), pa.array([tokens])], names=["w", "tokens"])

        # at most 8 rows of the size of the model
        sums = (texts.select("ids").mapInArrow(run, "w binary, tokens long").repartition(8)
                .mapInArrow(add, "w binary, tokens long").collect())
        if not sums:
            break
        trained = sum(r["tokens"] for r in sums)
        total = sum(np.frombuffer(r["w"], np.float32).astype(np.float64) for r in sums) / trained
        weights, at = {}, 0
        for k in _NAMES:
            size = math.prod(shapes[k])
            weights[k] = now[k] + total[at:at + size].reshape(shapes[k]).astype(np.float32)
            at += size
    return weights, trained


def score_texts(docs: DataFrame, tokenizer: str, folds: int = 10, held_out: int = 0, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10 probabilities) of every text; rows whose id hashes to ``held_out``
    of ``folds`` are not learned from."""
    make = encoder("word", tokenizer)
    n_ids = make.tokenizer.get_vocab_size() + 1  # the end id is the last
    assert n_ids <= 65_536, "ids are kept as 16-bit numbers"
    ends_word = np.zeros(n_ids, np.int64)
    for token, i in make.tokenizer.get_vocab().items():
        ends_word[i] = token.endswith("</w>")

    rows = _chunked(docs, folds, held_out)
    used = stored(_chunk_words(rows), "chunk-words")
    words = stored(_word_ids(used.groupBy("word").agg(F.sum("n").alias("n")), tokenizer), "words")
    known = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    trained = rows.where("train").count()
    total, distinct = int(known["n"] or 0) + trained, int(known["v"] or 0) + (trained > 0)

    base = scratch_path(docs.sparkSession, "dictionaries")
    # a word that every chunk has is split by adaptive execution
    (used.select("chunk", "word").join(words, "word").repartition("chunk")
     .write.partitionBy("chunk").parquet(base))
    counts = _id_counts(words, n_ids)
    counts[-1] = trained
    classes = make_classes(counts, ends_word)
    floor = total + 0.1 * (distinct + 1)
    texts, within = _digest(rows, base, classes, trained, floor)
    bigram = within.bigram()
    weights, _ = _train(texts.where(~F.col("held_out")), bigram, classes, rounds)
    pairs = by_pair(expert_tables(weights, bigram))
    n, of = classes.n, input_classes(classes)

    def run(batches):
        room = np.empty((512, *_SEEN.shape), np.float32)
        for b in batches:
            ids = b.column(5).to_pylist()
            scores = np.zeros(len(ids))
            for lo, hi, got, size in _parts(ids):
                x, y, text = windows(got, size, n_ids)
                inside = within.logs(got, class_before(classes.of[got], size, n))
                logs = np.bincount(np.repeat(np.arange(hi - lo), size), inside, minlength=hi - lo)
                for i in range(0, len(x), 512):
                    p = log_probabilities(weights, pairs, x[i:i + 512], of[y[i:i + 512]], of, room[:len(x) - i])
                    logs += np.bincount(text[i:i + 512], p.sum(axis=1, dtype=np.float64), minlength=hi - lo)
                scores[lo:hi] = logs / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(4)), pa.array(np.full(len(ids), total, np.int64)), b.column(4), pa.array(scores)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
                            " base_score double, score double")


class _NoWords:
    """The dictionary of a chunk without any word."""

    number: dict = {}
    count = np.empty(0, np.int64)
    flat = np.empty(0, "<u2")
    length = start = np.empty(0, np.int64)
    texts, ids = Dictionary.texts, Dictionary.ids


def _dictionary(base: str, chunk: int, texts: list[bytes]):
    try:
        return Dictionary(base, chunk)
    except FileNotFoundError:
        if any(t.split() for t in texts):
            raise
        return _NoWords()
