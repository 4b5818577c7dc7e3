"""op2: deep paths whose segments always come together are mined as one item, with the same rules and verdicts."""

import time
from itertools import combinations

from netprism.llm import url_rules


def brute(data, support, confidence):
    """Every rule of every token set, those no better than a set with one token less left out."""
    tokens = sorted({t for x, _ in data for t in x})
    rules = {}
    for size in range(1, len(tokens) + 1):
        for items in combinations(tokens, size):
            fit = [y for x, y in data if set(items) <= set(x)]
            for v in ("allow", "block"):
                hit = fit.count(v)
                if hit and hit >= support * len(data) and hit / len(fit) >= confidence:
                    rules[items, v] = (hit / len(fit), hit / len(data))
    return {k: c for k, c in rules.items() if not any(
        (p, k[1]) in rules and rules[p, k[1]][0] >= c[0] for p in combinations(k[0], len(k[0]) - 1))}


def expanded(rules):
    out = {}
    for r in rules:
        sets = [()]
        for some in r["alternatives"]:
            sets = [s + (t,) for s in sets for t in some]
        for s in sets:
            out[tuple(sorted(s)), r["verdict"]] = (round(r["confidence"], 9), round(r["support"], 9))
    return out


def baskets(k):
    deep = [f"p{i:02d}=x" for i in range(k)]
    return ([(deep + ["q=a"], "block")] * 6 + [(deep, "allow")] * 5 + [(["q=a"], "allow")] * 7
            + [(["h=z", "q=b"], "block")] * 4 + [(["h=z"], "allow")])


def test_same_rules_as_brute_force(spark):
    data = baskets(6)
    got = url_rules.mine_rules(spark.createDataFrame(data, "items array<string>, label string"), 0.1, 0.7).collect()
    wanted = {k: (round(c, 9), round(s, 9)) for k, (c, s) in brute(data, 0.1, 0.7).items()}
    assert any(len(k[0]) == 2 for k in wanted) and expanded(got) == wanted


def test_many_equal_segments_take_seconds(spark):
    data = baskets(25)
    start = time.time()
    rules = url_rules.mine_rules(spark.createDataFrame(data, "items array<string>, label string"), 0.1, 0.7)
    assert rules.count() < 20 and time.time() - start < 60
    sets = spark.createDataFrame([(["p07=x", "q=a"],), (["p07=x"],), (["q=b", "u"],)], "tokens array<string>")
    got = {tuple(r["tokens"]): (r["verdict"], r["items"]) for r in url_rules.match_rules(sets, rules).collect()}
    assert got == {("p07=x", "q=a"): ("block", ["p07=x", "q=a"]), ("q=b", "u"): ("block", ["q=b"])}


def test_no_baskets(spark):
    empty = spark.createDataFrame([], "items array<string>, label string")
    rules = url_rules.mine_rules(empty)
    assert rules.collect() == [] and "alternatives" in rules.columns
