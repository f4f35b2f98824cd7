"""Groups of similar names against plain loops over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from newsignal.operators import fuzzy
from newsignal.operators.store import Scratch
from newsignal.plans import kernels


def plain_ratio(a, b):
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def plain_leaders(rows, least):
    first = {}
    for n, at in rows:
        if n is not None:
            first[n] = min(first.get(n, at), at)
    key, heads, out = lambda n: " ".join(sorted(n.lower().split())), [], {}
    for n in sorted(first, key=lambda n: (first[n], n)):
        best = max(((plain_ratio(key(n), key(h)), -k) for k, h in enumerate(heads)), default=(0.0, 0))
        if best[0] >= least:
            out[n] = heads[-best[1]]
        else:
            out[n] = n
            heads.append(n)
    return out


def made_names(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    out = []
    for _ in range(n):
        name = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(name) + 1)
            name = name[:k] + rng.choice(["", "x", "a"]) + name[k + rng.choice([0, 1]) :]
        out.append((rng.choice([name, name.title()]), rng.randrange(6)))
    return out


@pytest.mark.parametrize("seed, least", [(1, 85.0), (2, 85.0), (3, 70.0), (4, 100.0)])
def test_leader_groups_equal_plain_loops(spark, seed, least):
    rows = [*made_names(seed, 130), ("aaaaaaaa", 1), ("aaaaaaaaa", 2), ("", 3), (" ", 4), (None, 0), ("Acme Tools", 1), ("tools ACME", 0), ("Zacme Tools", 9)]
    df = spark.createDataFrame(rows, "n string, at int").withColumn("s", F.lit("clash"))
    got = {r["n"]: r["canonical"] for r in fuzzy.leader_groups(df, "n", "at", least).collect()}
    assert got == plain_leaders(rows, least)


def test_similar_texts_lose_no_pair(spark):
    texts = sorted({" ".join(sorted(n.lower().split())) for n, _ in made_names(9, 200)})
    got = {(r["x"], r["y"]): r["ratio"] for r in fuzzy.similar_texts(spark.createDataFrame([(t,) for t in texts], "s string"), 75.0, Scratch(spark)).collect()}
    want = {(a, b): plain_ratio(a, b) for a in texts for b in texts if a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 75.0})


def test_name_groups_query(spark, small):
    out = kernels.name_groups(spark, small).collect()
    led = {r["name"]: r["canonical"] for r in out}
    assert len(led) == len(out) and all(led[c] == c for c in led.values())


def test_few_texts_that_are_not_similar_are_compared(spark):
    rng = random.Random(4)
    parts = ["ing", "tion", "ed", "ver", "or", "at", "en", "osh", "ra", "ga", "ly", "th"]
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(500)})
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    met = {(r["x"], r["y"]) for r in fuzzy.text_pairs(df, 85.0, Scratch(spark)).collect()}
    true = {(a, b) for a in texts for b in texts if a < b and plain_ratio(a, b) >= 85.0}
    assert true <= met and len(met) < 2 * len(texts), (len(met), len(true))  # all pairs are 250 times as many as texts
