"""Binary files in byte ranges."""

import math
import os
from collections import Counter

import pytest

from netprism.sources import chunks


def test_ranges_cover_every_file_once():
    files = [("a", 10), ("b", 0), ("c", 25), ("d", 1), ("e", 64)]
    parts = chunks.cut(files, 16)
    seen = {name: [] for name, _ in files}
    for p in parts:
        assert sum(stop - start for _, _, start, stop in p.ranges) <= 16
        for path, size, start, stop in p.ranges:
            assert size == dict(files)[path]
            seen[path].append((start, stop))
    for name, size in files:
        at = 0
        for start, stop in sorted(seen[name]):
            assert start == at
            at = stop
        assert at == size and seen[name]
    assert len(parts) >= 100 // 16


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    data = {"big.bin": os.urandom(100_003), "zero.bin": b"\0" * 5000, "text.bin": b"MZ plain words " * 900, "empty.bin": b"",
            "one.bin": b"x", "other.txt": b"not of the glob", "_hidden.bin": b"no"}
    (folder / "deep").mkdir()
    for name, content in data.items():
        (folder / ("deep" if name == "one.bin" else "") / name).write_bytes(content)
    return str(folder), data


def test_chunks_put_together(spark, corpus):
    folder, data = corpus
    df = chunks.read_chunks(spark, "file:" + folder, "*.bin", chunk_bytes=1000, partition_bytes=7777)
    assert df.rdd.getNumPartitions() > 10
    rows = df.collect()
    assert max(len(r["chunk"]) for r in rows) <= 1000
    whole = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["offset"])):
        name = os.path.basename(r["path"])
        assert r["offset"] == len(whole.setdefault(name, b"")) and r["file_bytes"] == len(data[name])
        whole[name] += bytes(r["chunk"])
    assert whole == {k: v for k, v in data.items() if k.endswith(".bin") and not k.startswith("_")}
    assert chunks.read_chunks(spark, "file:" + folder, "*.none").count() == 0


def test_profile_equals_that_of_one_piece(spark, corpus):
    folder, data = corpus
    many = chunks.read_chunks(spark, folder, "*.bin", chunk_bytes=777, partition_bytes=5000)
    for r in chunks.byte_profile(many).collect():
        content = data[os.path.basename(r["path"])]
        counts, n = Counter(content), len(content)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        assert r["n_bytes"] == n == r["file_bytes"] and r["magic"] == content[:4].hex().upper()
        assert r["entropy"] == pytest.approx(entropy, abs=1e-9)
        if n:
            assert r["null_pct"] == pytest.approx(100 * counts[0] / n)
            assert r["printable_pct"] == pytest.approx(100 * sum(c for b, c in counts.items() if 32 <= b <= 126) / n)
