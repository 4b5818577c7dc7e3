"""Periodic runs, the Merkle manifest and mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from netprism.llm import merkle, mixing, periodic_runs, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated rows, a hot source, clashing names."""
    rows = [(1, "a", "en", 3, "x\ny " * 20, 7), (1, "a", "en", 3, "x\ny " * 20, 7), (1, "a", "en", 3, "other\n", 7),
            (None, None, None, None, None, None), (None, "", "en", 0, "", 1), (5, "é", "en", 3, None, 0),
            (6, "z", "en", 3, "l\n" * 5000, 0), (7, None, "é", 2, "p q", 1), (8, "b", "en", 0, " \t\n\r\x0b\x0c ", 2)]
    rows += [(i, "hot", "xx", i, f"{i}\n" + "one two three four " * (i % 7), 0) for i in range(10, 310)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree int").repartition(3)


def plain_runs(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n, s = j - i + q, w[i:j + q]
            if n >= max(least, 2 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randint(0, 60), "abcd"[:rng.choice([1, 2, 2, 3, 4])]
        w = [rng.choice(letters).encode() for _ in range(n)]
        if n and rng.random() < 0.6:
            p, s = rng.randint(1, n), rng.randrange(n)
            w[s:] = (w[s:s + p] * n)[:n - s]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = b"z"
        for least in (2, 5, 12):
            assert periodic_runs.runs_of(w, least) == plain_runs(w, least), w
            assert periodic_runs.find_runs(w, least) == plain_runs(w, least), w


def test_long_periodic_texts():
    assert periodic_runs.find_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    w = [str(i % 700).encode() for i in range(30_000)]
    assert periodic_runs.find_runs(w) == [(0, 30_000, 700)]


def plain_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_row(doc_id, text):
    w = plain_words(doc_id, text)
    runs = plain_runs(w, 12)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    tail = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return (doc_id, len(runs), *tail, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_op11_digests(spark, odd):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r[c] for c in columns) for r in queries.op11_periodic_runs(spark, SF).collect()}
    few = [r for r in docs.collect() if len(r["text"] or "") < 4000]
    assert len(few) > 100
    for r in few:
        assert run_row(r["doc_id"], r["text"]) in got
    found = periodic_runs.run_digests(periodic_runs.document_runs(odd.where("doc_id <> 6 or doc_id is null"),
                                                                  words=periodic_runs.repeated_words))
    want = Counter(run_row(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 6)
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == want
    assert periodic_runs.document_runs(odd.limit(0)).count() == 0
    whole = {r["doc_id"]: r for r in periodic_runs.document_runs(odd).collect()}
    assert whole[6]["runs"][0].asDict() == {"start": 0, "length": 5000, "period": 1} and whole[6]["collapsed"] == "l"


def fold(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """(root, for each leaf its (place, run) of every level)."""
    path, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, k in enumerate(at):
            path[i].append((k % 3, level[k // 3 * 3:k // 3 * 3 + 3]))
            at[i] = k // 3
        level = [fold(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return (level[0] if level else None), path


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = fold(*[field(r[c]) for c in merkle.FIELDS])
        groups[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[0][2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in order}
    root, top = plain_tree([trees[s][0] for s in order])
    for k, s in enumerate(order):
        for ((_, _, leaf), r), path in zip(sorted(groups[s], key=lambda x: x[0]), trees[s][1], strict=True):
            text = r["text"]
            if text is not None and zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 2 == 0:
                text = text.replace("\n", "")
            h, siblings = fold(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))), []
            for place, run in path + top[k]:
                siblings += run[:place] + run[place + 1:]
                h = fold(*run[:place], h, *run[place + 1:])
            yield r["doc_id"], leaf, trees[s][0], root, fold(*siblings), h, h == root


@pytest.mark.parametrize("where", ["true", "source = 'z'", "source = 'hot'", "false", "source is null"])
def test_manifest_of_odd_rows(odd, where):
    docs = odd.where(where)
    got = Counter(tuple(r) for r in merkle.document_manifest(docs).collect())
    assert got == Counter(plain_manifest(docs.collect()))


def test_proofs_need_the_right_leaf(odd):
    m = merkle.build(odd.select("doc_id", "source", merkle.leaf([odd[c] for c in merkle.FIELDS]).alias("leaf")))
    from pyspark.sql import functions as F

    rows = merkle.with_proofs(m)
    ends = rows.select(merkle.folded(F.col("leaf"), F.col("siblings"), F.col("places"), 3).alias("own"),
                       merkle.folded(F.sha2("leaf", 256), F.col("siblings"), F.col("places"), 3).alias("other"), "root").collect()
    assert len(ends) == odd.count() and all(r["own"] == r["root"] != r["other"] for r in ends)


def plain_targets(size, weights=(5, 2, 1), most=3):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(size.values())
    while True:
        left = total - sum(most * size[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        new = [s for s in names if s not in full and Fraction(left * w[s], open_) >= most * size[s]]
        if not new:
            return {s: float(most * size[s]) if s in full else float(Fraction(left * w[s], open_)) for s in names}
        full |= set(new)


def mixed(docs, **kw):
    rows, pieces = mixing.mix(docs, **kw)
    rows, pieces = rows.collect(), pieces.collect()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = plain_targets(dict(size)) if size else {}
    numbered = {r["_row"]: r for r in rows}
    assert len(numbered) == len(rows) == docs.count()
    source = {}
    taken, cover, slots = Counter(), defaultdict(list), defaultdict(set)
    for p in pieces:
        source[p["_row"]] = p["source"]
        taken[p["source"]] += p["length"]
        cover[p["_row"], p["epoch"]].append((p["start"], p["length"]))
        slots[p["shard"]].add(p["slot"])
    assert {s: taken[s] for s in want} == {s: round(t) for s, t in want.items()}
    for (row, epoch), spans in cover.items():
        at = 0
        for start, n in sorted(spans):
            assert start >= at and n > 0
            at = start + n
        assert at <= numbered[row]["size"] and epoch < 3
        assert numbered[row]["target"] == pytest.approx(want[source[row]])
        assert numbered[row]["source_size"] == size[source[row]]
    assert all(s == set(range(len(s))) for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    return rows, pieces


def test_mix_takes_the_targets(spark, odd):
    mixed(spark.read.parquet(f"{SF}/documents.parquet"), block=50, shard_blocks=7)
    rows, pieces = mixed(odd, block=4, shard_blocks=3)
    again = mixed(odd.repartition(2), block=4, shard_blocks=3)

    def plain(found):
        return (Counter((r["doc_id"], r["size"], r["target"]) for r in found[0]),
                Counter((p["shard"], p["slot"], p["doc_id"], p["source"], p["start"], p["length"]) for p in found[1]))

    assert plain((rows, pieces)) == plain(again)
    for where in ("doc_id = 5", "false", "doc_id is null", "source = 'hot'"):
        mixed(odd.where(where), block=4, shard_blocks=3)


def test_quota_splitting_is_exact_and_hypergeometric(spark):
    quota = np.array([400, 0, 90, 10])
    rows = mixing.split_quotas(spark, quota, shard_blocks=2, seed=3, fan=4).orderBy("shard").collect()
    parts = np.array([r["quota"] for r in rows])
    assert (parts.sum(axis=0) == quota).all() and set(parts.sum(axis=1)) == {2} and len(rows) == 250
    assert (np.array([r["before"] for r in rows]) == np.cumsum(parts, axis=0) - parts).all()
    # the first half of the shards holds about half of each source
    means = np.mean([mixing.halves(quota, 0, 250, 2, seed)[0] for seed in range(300)], axis=0)
    assert np.allclose(means, quota / 2, atol=2.0)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    orders = [tuple(mixing.permuted(np.arange(n), n, [k]).tolist()) for k in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders) and (n < 10 or len(set(orders)) == 3)


def test_piece_words(odd):
    docs = odd.where("doc_id > 12 and source = 'hot'")
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    _, pieces = mixing.mix(docs, block=4, shard_blocks=3)
    for p in mixing.piece_words(docs, pieces).collect():
        assert p["words"] == " ".join(words[p["doc_id"]][p["start"]:p["start"] + p["length"]])


def test_op13_reruns_agree(spark):
    once, twice = ([tuple(r) for r in queries.op13_source_mixture(spark, SF).orderBy("doc_id").collect()] for _ in range(2))
    assert once == twice and all(0 <= r[4] <= 3 * r[1] for r in once)
