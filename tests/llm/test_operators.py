"""Small tests of each operator: brute force, round trips, and the cases that docstrings define."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsignal.llm import bpe, chat, decontam, htmltext, jaccard, licenses, quality, rans, toxicity, urls
from newsignal.llm.components import connected_components

ODD = [(None, "some words without a number for them"), (900, None), (901, ""), (902, " \t\n"), (903, "same row"), (903, "same row")]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- 1 ---


def test_quality_keeps_good_and_drops_junk(spark, docs, prose):
    good = [(k, prose(120, k)) for k in range(60)]
    junk = [(100 + k, " ".join(w + "###" for w in prose(120, 1000 + k).split())) for k in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in junk[:10]], "doc_id long, quality int, toxic int")
    d = docs(good + junk + ODD).withColumn("kept", F.lit("clash"))
    out = {r["doc_id"]: r for r in quality.rate_quality(d, quality.fit(d, labels)).collect()}
    assert all(out[i]["kept"] for i, _ in good) and not any(out[i]["kept"] for i, _ in junk)
    assert out[900]["n_words"] == 0 and out[900]["base_failed"] and not out[901]["kept"]


def test_quality_of_nothing(spark, docs):
    d = docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rate_quality(d, quality.fit(d, labels)).count() == 0


def brute_buckets(text):
    """Every n-gram of a text by plain loops, as (kind, key)."""
    w = text.split()
    return [("word", x) for x in w] + [("two", a, b) for a, b in zip(w, w[1:])]


def test_quality_ratio_by_plain_loops(spark, docs, prose):
    import math
    from collections import Counter

    texts = {k: prose(60, k) for k in range(40)}
    good = [k for k in texts if k % 4]
    labels = spark.createDataFrame([(k, int(k in good), 0) for k in texts], "doc_id long, quality int, toxic int")
    d = docs(list(texts.items()))
    ratio = quality.fit(d, labels)
    out = {r["doc_id"]: r["llr"] for r in quality.rate_quality(d, ratio).collect()}
    # The same multinomials, by each text's own list of buckets.
    own = {}
    for k, t in texts.items():
        buf = np.frombuffer(t.encode(), np.uint8)
        parsed = quality._parse(buf, np.array([0, len(buf)]))
        own[k] = [int(x) for bucket, _ in quality.grams(buf, *parsed) for x in bucket]
        words = t.split()
        assert len(own[k]) == 2 * len(words) + 2 * (len(words) - 1)
    raw, target = Counter(), Counter()
    for k, b in own.items():
        raw.update(b)
        if k in good:
            target.update(b)
    weight = lambda b: math.log((target[b] + 1) / (sum(target.values()) + quality.BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + quality.BUCKETS))
    for k, b in own.items():
        assert out[k] == pytest.approx(sum(map(weight, b)) / len(b), abs=1e-9)


def test_quality_counts_pairs_of_words():
    buf = np.frombuffer(b"one two three one two", np.uint8)
    parsed = quality._parse(buf, np.array([0, len(buf)]))
    words, pairs = (b.tolist() for b, _ in quality.grams(buf, *parsed)[:2])
    assert words[0] == words[3] and pairs[0] == pairs[3] and len(set(pairs)) == 3 and len(pairs) == 4


def test_quality_threshold_is_out_of_sample(spark, docs, prose):
    texts = [(k, prose(80, k)) for k in range(80)]
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    # Good and bad are alike, so no cut may tell them apart well: in sample every text's own words would.
    d = docs(texts)
    out = quality.rate_quality(d, quality.fit(d, labels)).filter("not base_failed").collect()
    assert sum(not r["kept"] for r in out if r["doc_id"] < 60) == 0


def brute_threshold(good, bad):
    """Every cut, one after another; the first of the best."""
    best, most = None, int(quality.TRUSTED_LOSS * len(good))
    values = sorted({*good, *bad})
    for c in values:
        lost, caught = sum(x < c for x in good), sum(x < c for x in bad)
        if lost <= most and (best is None or caught / len(bad) - lost / len(good) > best[0]):
            best = (caught / len(bad) - lost / len(good), c)
    return (max((x for x in values if x < best[1]), default=best[1] - 1e-9) + best[1]) / 2


def test_quality_threshold_is_fitted_on_every_labelled_row(spark, docs, prose):
    n, few = 5_600, 300
    # Good rows beyond the first 5,000 by hash look like bad ones, so that a sample by hash sees none of them.
    late = {r["id"] for r in spark.range(n).orderBy(F.xxhash64("id")).tail(600)}
    texts = [(k, prose(40, k) + " #a" * 12 if k in late or k >= n and k % 3 else prose(50, k)) for k in range(n + few)]
    labels = spark.createDataFrame([(k, int(k < n), 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    fold = dict(spark.range(n + few).select("id", F.pmod(F.xxhash64("id"), F.lit(quality.FOLDS))).collect())
    counts, own = np.zeros((1 + quality.FOLDS, quality.BUCKETS)), {}
    for k, t in texts:
        buf = np.frombuffer(t.encode(), np.uint8)
        own[k] = np.concatenate([b for b, _ in quality.grams(buf, *quality._parse(buf, np.array([0, len(buf)])))])
        np.add.at(counts[0], own[k], 1)
        if k < n:
            np.add.at(counts[1 + fold[k]], own[k], 1)
    weights = [quality.ratio_weights(counts[0], counts[1:].sum(0) - counts[1 + k]) for k in range(quality.FOLDS)]
    mean = {k: weights[fold[k]][b].mean() for k, b in own.items()}
    want = brute_threshold([mean[k] for k in range(n)], [mean[n + k] for k in range(few)])
    assert quality.fit(docs(texts), labels).threshold == pytest.approx(want, abs=1e-12)


def test_quality_threshold_by_plain_loops(spark):
    rng = random.Random(3)
    for size, spread in ((400, 0), (1200, 1), (1, 2)):
        good = [round(rng.gauss(0.5, 0.3), 2) for _ in range(2 * size)]
        bad = [round(rng.gauss(-0.4 * spread, 0.3), 2) for _ in range(size)]  # rounded: many ties
        rows = [(1, x) for x in good] + [(0, x) for x in bad]
        assert quality.best_threshold(spark.createDataFrame(rows, "quality int, mean double")) == brute_threshold(good, bad)
    some = spark.createDataFrame([(1, 0.5), (1, 0.25)], "quality int, mean double")
    assert quality.best_threshold(some) == 0.25 - 1e-9 and quality.best_threshold(some.limit(0)) == -np.inf


def test_quality_cases(spark, docs, prose):
    good = [(k, prose(120, k)) for k in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] * 3 + [(None, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    long = " ".join(prose(4000, 7) for _ in range(60))  # longer than a slice
    d = docs([*good, *good[:3], (500, long), *ODD])
    out = quality.rate_quality(d, quality.fit(d, labels)).collect()
    assert len(out) == 30 + 3 + 1 + len(ODD)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[500]["n_words"] == 60 * 4000 and by_id[0]["kept"]
    assert len({r["llr"] for r in out if r["doc_id"] == 1}) == 1
    none = quality.rate_quality(d, quality.fit(d, labels.limit(0)))
    assert all(r["kept"] != r["base_failed"] for r in none.collect())


# --- 2 ---


def test_license_digest_ignores_case_copyright_and_spelling(spark, docs):
    mit = licenses.LICENSES[0][1]
    changed = "Copyright (c) 2019 Some Body\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;")
    d = docs([(1, mit), (2, changed), (3, mit + " and more"), (4, "text\nReleased under the MIT Licence!\nmore\nreleased  under the mit license"), *ODD])
    out = {r["doc_id"]: r for r in licenses.scan_licenses(d, licenses.known_licenses(spark)).collect()}
    assert out[1]["license_id"] == out[2]["license_id"] == "MIT" and out[3]["license_id"] is None
    assert (out[4]["n_notices"], out[4]["notices"]) == (2, "MIT") and out[900]["digest"] == hashlib.sha256(b"").hexdigest()
    texts = [t for _, t in licenses.LICENSES] + [changed, "a\n© 2020 b\n(c) 1999 c\nall rights reserved.\nd"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", licenses.canonical(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in sorted(got)] == [licenses.canonical_text(t) for t in texts]


def test_license_spelling_of_neighbours_and_copyright_lines():
    assert licenses.canonical_text("licence licence, Licence") == "license license license"
    assert licenses.canonical_text("a\nCopyright Jane Doe\nCopyright (c) The Authors\n© X\n(c) You must retain\nCOPYRIGHT HOLDERS and") == "a c you must retain copyright holders and"


def test_license_lines_whose_number_of_words_changes_by_spelling(spark, docs):
    text = "One percent of percent percent noncommercial work and percent of it under this licence"
    known = licenses.known_licenses(spark, [("X", text)], [])
    d = docs([(1, text), (2, "before\n" + text.replace("percent", "per cent").replace("noncommercial", "Non-Commercial") + "\nafter"), (3, "x\n" + text.upper()), (4, text + " percents"), (5, "noncommercial\n" + text.replace("percent", "per cent", 2))])
    out = {r["doc_id"]: (r["license_id"], r["n_notices"]) for r in licenses.scan_licenses(d, known).collect()}
    assert out == {1: ("X", 1), 2: (None, 1), 3: (None, 1), 4: (None, 0), 5: (None, 1)}


def test_long_licenses_are_known(spark, docs):
    import os

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    texts = {n: open(f"{folder}/{n}", encoding="utf-8").read() for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    every = list(texts.items())
    d = docs([(k, "Copyright 2020 Somebody Else\n\n" + t.replace("\n", "\n\n").upper()) for k, (_, t) in enumerate(every)] + [(50, every[0][1] + " more")])
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(d, licenses.known_licenses(spark)).collect()}
    assert [out[k] for k in range(6)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"] and out[50] is None


def test_license_cases(spark, docs, prose):
    known = licenses.known_licenses(spark)
    notice = "Released under the MIT License."
    d = docs([*ODD, (1, "\n".join([notice] * 3000)), (2, notice), (2, notice)]).withColumns({c: F.lit("clash") for c in ("digest", "license_id", "_words", "n_words")})
    out = licenses.scan_licenses(d, known).collect()
    assert len(out) == len(ODD) + 3
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["n_notices"] == 3000 and by_id[2]["n_notices"] == 2 and by_id[2]["license_id"] == "MIT" and by_id[None]["n_notices"] == 0
    assert licenses.scan_licenses(docs([]), known).count() == 0
    assert all(r["license_id"] is None and not r["n_notices"] for r in licenses.scan_licenses(d, known.limit(0)).collect())


# --- 3 ---


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join_is_exact(spark, docs, prose):
    rng = random.Random(3)
    texts = []
    passage = prose(60, 77)
    for k in range(12):
        base = prose(150, k).split()
        for c in range(8):
            words = base[:]
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(50))
            if c % 4 == 3:
                words = words[: rng.randint(100, 150)]
            texts.append((len(texts), " ".join(words).upper() if c == 2 else " ".join(words)))
    texts += [(len(texts) + k, passage + " " + prose(20, 500 + k)) for k in range(25)]
    texts += [(500, "one two"), (501, "One  TWO"), (502, "one two three"), (503, None), (504, ""), (505, "a b c d e"), (506, "a b c d e f")]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs(texts)).collect()}
    assert out == brute_components(texts)


def test_jaccard_cases(spark, docs):
    out = rows(jaccard.link_documents(docs([*ODD, (7, "same row")])), "doc_id", "n_shingles", "component_id")
    assert out == sorted([(None, 3, None), (900, 0, 900), (901, 0, 901), (902, 0, 902), (903, 1, 7), (903, 1, 7), (7, 1, 7)], key=str)
    assert jaccard.link_documents(docs([])).count() == 0


@pytest.mark.parametrize("short, block", [(16, 1 << 16), (2, 400), (0, 150)])
def test_jaccard_of_one_large_group(spark, docs, prose, monkeypatch, short, block):
    """Near copies of one text around the threshold, by homes, pairs, and cells of one and of several blocks."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rng = random.Random(8)
    base, other = prose(120, 1).split(), prose(90, 2).split()
    texts = []
    for k in range(110):
        words = (base if k % 3 else base[:40] + other)[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = "w" + str(rng.randrange(9 if k % 2 else 10**6))
        if k % 10 == 9:
            words = words[: rng.randint(90, 120)]
        texts.append((k, " ".join(words)))
    texts += [(200, base * 40 and " ".join(base * 40)), (201, " ".join(base * 39 + ["x"]))]
    d = docs(texts).withColumns({c: F.lit("clash") for c in ("n", "root", "token", "component_id")})
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(d).collect()}
    want = brute_components(texts)
    assert out == want and len({c for _, c in want.values()}) > 5


def brute_documents(texts):
    """Components of documents: texts that link, and rows that share a doc_id, belong together."""
    by_row = brute_components([(k, t) for k, (_, t) in enumerate(texts)])
    ids = {k: i for k, (i, _) in enumerate(texts)}
    top = {i: i for i in ids.values()}
    while True:
        before = dict(top)
        for k, (n, c) in by_row.items():
            if n:
                least = min(top[ids[k]], top[ids[c]])
                top[ids[k]] = top[ids[c]] = least
        if top == before:
            return sorted((ids[k], n, top[ids[k]] if n else ids[k]) for k, (n, _) in by_row.items())


def test_jaccard_of_rows_that_share_a_doc_id(spark, docs, prose):
    x, y, z = prose(40, 1), prose(40, 2), prose(40, 3)
    five = [(3, x), (5, x + " more"), (5, y), (7, y + " more"), (9, z)]
    assert [r[2] for r in rows(jaccard.link_documents(docs(five)), "doc_id", "n_shingles", "component_id")] == [3, 3, 3, 3, 9]
    rng = random.Random(12)
    texts = []
    for k in range(160):
        words = prose(60, rng.randrange(45)).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = "w" + str(rng.randrange(30))
        texts.append((rng.randrange(110), " ".join(words)))
    texts += [(5, ""), (6, None), *texts[:10]]
    got = rows(jaccard.link_documents(docs(texts)), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == brute_documents(texts) and len({c for _, _, c in got}) > 3


def test_jaccard_of_a_very_long_text(spark, docs, prose):
    long = prose(60_000, 5)
    texts = [(1, long), (2, long + " tail of it"), (3, prose(60_000, 6)), (4, long[: len(long) // 2])]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs(texts)).collect()} == brute_components(texts)


def test_divide_skip_counts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        q = np.unique(rng.integers(0, 200, rng.integers(1, 120))).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(q)) < rng.random() * 0.3, rng.integers(0, 400, len(q)), q)).astype(np.uint64) for _ in range(rng.integers(1, 20))]
        for s, got in zip(sets, jaccard.divide_skip(q, sets), strict=True):
            shared = len(np.intersect1d(q, s))
            assert got == (shared if 100 * shared >= 80 * (len(q) + len(s) - shared) else -1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 90), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90}


# --- 4 ---


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "x")], "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["perspective"]): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    ann = out[1, "ann"]
    assert ann["rendered"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert list(ann["mask"]) == [0, 1, 0, 1] and [ann["rendered"][s["start"] : s["end"]] for s in ann["target_spans"]] == ["hi<|im_end|>", "<|im_end|>"]
    assert out[3, "unknown"]["chunk"] == -1
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_long_conversations_are_chunked(spark):
    turns = spark.range(200).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit("t").alias("text"))
    out = chat.rotate_perspectives(turns).filter("perspective = 'a'").orderBy("chunk").collect()
    assert [r["n_turns"] for r in out] == [64, 64, 64, 8]


# --- 5 ---


def test_url_rules(spark):
    cases = ["http://a.example.net/en/1", "http://example.net/de/", "http://x.example.com/de/?q", "https://ORG/fr/a", "ftp://fooexample.net/en/", "http://example.net", "no url", None, "http://a.net/x://b.org/fr/", "http://example.com/DE/"]
    pages = spark.createDataFrame([(k, u, "<p>example free bets</p>") for k, u in enumerate(cases)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert [out[k]["rule"] for k in range(len(cases))] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", "net/", None, None, None, "net/", None]
    assert (out[3]["host"], out[3]["path"], out[6]["host"], out[7]["path"]) == ("org", "/fr/a", "", "")
    assert all(r["verdict"] in ("allow", "block") for r in out.values())
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_rare_words_and_long_runs_are_segmented(spark):
    import itertools
    import math

    common = ["x" + "".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 100_010)]
    html = [" ".join(common), " ".join(common), "zebra quokka casino", ""]
    url = ["http://a.net/1", "http://example.net/en/2", "http://zebraquokka.b.info/3", f"http://b.info/{'casino' * 60}"]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(zip(url, html))], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert out[2]["words"].split()[:2] == ["h:zebra", "h:quokka"] and out[3]["words"] == "h:b h:info" + " p:casino" * 60
    # naive Bayes by hand: h:a h:net p:#1 is blocked, h:example h:net p:en p:#1 is allowed
    seen = {"h:a": (1, 0), "h:net": (1, 1), "p:#1": (1, 1), "h:example": (0, 1), "p:en": (0, 1)}
    nb, na = 3 + 5 + 1, 4 + 5 + 1
    want = sum(math.log((b + 1) / nb) - math.log((a + 1) / na) for t in out[2]["words"].split() if t in seen for b, a in [seen[t]])
    assert abs(out[2]["score"] - want) < 1e-9


def test_segmentation_splits_known_words():
    import math

    counts = {"free": 50, "bets": 40, "casino": 30, "win": 60, "in": 500}
    total = sum(counts.values())
    logp = {w: math.log(n / total) for w, n in counts.items()}
    assert urls.segment("freebets", logp, total) == ["free", "bets"] and urls.segment("casinowin", logp, total) == ["casino", "win"]
    assert "".join(urls.segment("qqfreezz", logp, total)) == "qqfreezz"


def plain_segment(word, logp, total):
    """The best of all splits, by trying each."""
    cost = lambda p: logp.get(p, -math.log(max(total, 2.0)) - 2.0 * len(p))
    best = None
    for cuts in range(1 << (len(word) - 1)):
        parts, at = [], 0
        for k in range(1, len(word)):
            if cuts >> (k - 1) & 1:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        score = sum(map(cost, parts))
        if best is None or score > best[0] + 1e-12:
            best = score, parts
    return best


def test_url_split_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(60):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(8)]
        counts = {w: rng.randint(1, 50) for w in words}
        total = sum(counts.values()) + rng.randint(0, 1000)
        logp = {w: math.log(n / total) for w, n in counts.items()}
        text = "".join(rng.choice([*words, "x", "yz"]) for _ in range(3))[:12]
        got = urls.segment(text, logp, total)
        cost = lambda parts: sum(logp.get(p, -math.log(max(total, 2.0)) - 2.0 * len(p)) for p in parts)
        assert "".join(got) == text and cost(got) == pytest.approx(plain_segment(text, logp, total)[0])
    long = "q" * 90
    assert urls.segment(long + "free", {"free": -1.0, long: -2.0}, 100.0) == [long, "free"] and urls.segment("z" * 70, {"free": -1.0}, 100.0) == ["z" * 70]


def test_url_verdicts_by_plain_loops(spark):
    """Every word count, split, token count and score by dictionaries."""
    from collections import Counter

    pages = [(k, f"http://{a}{b}.{z}/{p}/{k}", f"<p>{a} {b} {a} reads {c}</p>") for k, (a, b, c, z, p) in enumerate((a, b, c, z, p) for a in ("casino", "news") for b in ("win", "daily") for c in ("bets", "story") for z in ("net", "org", "example.com", "io") for p in ("fr", "de"))]
    pages += [(900, None, "<p>casino</p>"), (901, "no url", None), (902, "http://casinowindaily.io/x", "")]
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    split = {i: (m[1].lower(), m[2]) if u and (m := re.search(r"://([^/?#]*)([^?#]*)", u)) else ("", "") for i, u, _ in pages}
    counts = Counter()
    for i, _, h in pages:
        host, path = split[i]
        text = re.sub(r"<[^>]*>|&#?[a-z0-9]+;|[a-z0-9-]+([.][a-z0-9-]+)+", " ", h.lower()) if h else ""
        hyphens = " ".join(x for x in host.split(".") if "-" in x)
        counts.update(w for w in re.split("[^a-z]+", " ".join([text, ".".join(host.split(".")[-2:]), hyphens, path.lower()])) if w)
    seg = urls.Segmenter(dict(counts), sum(counts.values()))
    tokens = {i: seg.tokens(*split[i]) for i, _, _ in pages}
    ruled = {i: max(((len(h + p), kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None))[1] for i, (host, path) in split.items()}
    b, a = (Counter(t for i, v in ruled.items() if v == kind for t in tokens[i]) for kind in ("block", "allow"))
    every = len({*b, *a})
    prior = math.log(sum(v == "block" for v in ruled.values()) / sum(v == "allow" for v in ruled.values()))
    for i, t in tokens.items():
        score = prior + sum(math.log((b[w] + 1) / (sum(b.values()) + every + 1)) - math.log((a[w] + 1) / (sum(a.values()) + every + 1)) for w in t if w in b or w in a)
        assert out[i]["words"].split() == t and out[i]["score"] == pytest.approx(score)
        assert out[i]["verdict"] == (ruled[i] or ("block" if score > 0 else "allow"))


# --- 6 ---


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    enc = bpe.encoder(path, pattern)
    return enc, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.vocabulary.ranks, special_tokens={})


def test_bpe_equals_the_library(reference, prose):
    enc, lib = reference
    rng = random.Random(9)
    alphabet = "abcdehinorst  \n\t'sét漢🙂019.,!?_-/\\#"
    for k in range(600):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) if k % 2 else "".join(chr(rng.choice([rng.randint(9, 126), rng.randint(0x80, 0x2FFF), rng.randint(0x10000, 0x1F9FF)])) for _ in range(30))
        ids = enc.encode(text)[0]
        assert ids == lib.encode_ordinary(text) and enc.decode(ids).decode() == text
    long = prose(3000)
    assert enc.encode(long)[0] == lib.encode_ordinary(long)


def test_bpe_edits_match_encoding_anew(reference):
    enc, _ = reference
    rng = random.Random(2)
    for _ in range(100):
        text = bytes(rng.choice(b"thein aereou") for _ in range(300))
        table = bpe.Prefixes(enc.vocabulary, text)
        a = rng.randrange(300)
        b = min(300, a + rng.randrange(6))
        new = bytes(rng.choice(b"the ing") for _ in range(rng.randrange(6)))
        done = table.replace(a, b, new)
        assert table.last == bpe.Prefixes(enc.vocabulary, text[:a] + new + text[b:]).last and done <= 300
        table.append(b"ing")
        assert table.last == bpe.Prefixes(enc.vocabulary, text[:a] + new + text[b:] + b"ing").last


def test_bpe_query_cases(spark, docs, reference):
    _, lib = reference
    d = docs([*ODD, (1, "Hello wörld 漢字")]).withColumn("n_tokens", F.lit("clash"))
    for r in bpe.encode_texts(d, *bpe.public_vocabulary()).collect():
        ids = lib.encode_ordinary(r["text"] or "")
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


# --- 7 ---


def test_leaks_are_found_and_clean_documents_left(spark, docs, prose):
    items = [(k, prose(30, 2000 + k).capitalize() + ". " + prose(8, 3000 + k) + ".") for k in range(30)]
    clean = [(k, prose(400, k)) for k in range(40)]
    dirty = [(100 + k, prose(150, 4000 + k) + "\n" + items[k][1].upper() + "\n" + prose(90, 5000 + k)) for k in range(20)]
    bench = spark.createDataFrame([*items, (None, "x"), (77, None), (78, "")], "item_id long, text string")
    d = docs(clean + dirty + ODD)
    found = decontam.find_leaks(d, bench).filter("leaked")
    assert rows(found, "doc_id", "item_id") == sorted([(100 + k, k) for k in range(20)], key=str)
    kept = {r["doc_id"] for r in decontam.drop_leaked(d, bench).collect()}
    assert kept == {i for i, _ in clean} | {i for i, _ in ODD}
    assert decontam.find_leaks(d, bench.limit(0)).count() == 0 and decontam.find_leaks(docs([]), bench).count() == 0


def test_block_max_wand_equals_all_scores(prose):
    index = decontam.build_index([(k, prose(12, k % 40)) for k in range(60)])
    rng = random.Random(1)
    for _ in range(60):
        query = sorted(rng.sample(range(len(index.terms)), rng.randint(1, min(60, len(index.terms)))))
        scores = {}
        for t in query:
            for s, x in zip(index.lists[t].segments, index.lists[t].impacts, strict=True):
                scores[s] = scores.get(s, 0) + x
        got = dict(decontam.block_max_wand(index, query, 0.2))
        assert got == pytest.approx({s: x for s, x in scores.items() if x >= 0.2 - 1e-9})


def test_leaks_dont_depend_on_the_size_of_indexes(spark, docs, prose):
    items = [(k, prose(40 + k, 2000 + k // 2).capitalize() + "\n" + prose(8, 3000 + k)) for k in range(40)]
    mixed = [(k, prose(100, k) + " " + " ".join(items[k][1].split()[: 30 + k]) + " " + prose(50, 90 + k)) for k in range(40)]
    bench, d = spark.createDataFrame(items, "item_id long, text string"), docs([*mixed, *mixed[:2], *ODD])
    fields = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leaked")
    one = rows(decontam.find_leaks(d, bench), *fields)
    size = sum(len(t) for _, t in items)
    assert one == rows(decontam.find_leaks(d, bench, size // 4), *fields) and len(one) > 30
    kept = lambda df: rows(df, "doc_id", "text")
    assert kept(decontam.drop_leaked(d, bench)) == kept(decontam.drop_leaked(d, bench, size // 4))


def test_leaks_by_plain_bm25(spark, docs, prose):
    """The query's rows against scores of every passage and item by plain loops."""
    import math
    from collections import Counter

    items = [(k, prose(20 + 3 * k, 2000 + k) + ". " + prose(6, 3000 + k)) for k in range(12)] + [(5, prose(25, 4000)), (30, "single"), (31, prose(90, 4001))]
    ds = [(k, prose(40, k) + " " + items[k % 12][1] + " " + prose(200, 300 + k)) for k in range(14)] + [(20, prose(300, 20)), (21, items[13][1]), (21, items[13][1]), (22, prose(30, 1) + " " + items[14][1])]
    words = lambda t: t.replace(".", " ").split()
    segments = []
    for i, t in items:
        w = words(t)
        cuts = -(-len(w) // decontam.SEGMENT)
        segments += [(i, w[len(w) * k // cuts : len(w) * (k + 1) // cuts]) for k in range(cuts)]
    mean, n, df = sum(len(w) for _, w in segments) / len(segments), len(segments), Counter(x for _, w in segments for x in set(w))
    part = lambda w, x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (decontam.K1 + 1) / (w.count(x) + decontam.K1 * (1 - decontam.B + decontam.B * len(w) / mean))
    want = Counter()
    for d, t in ds:
        w, best = [x.lower() for x in words(t)], {}
        for lo in range(0, len(w), decontam.PASSAGE // 2):
            passage = set(w[lo : lo + decontam.PASSAGE])
            for i, seg in segments:
                score = sum(part(seg, x) for x in set(seg) if x in passage) / sum(part(seg, x) for x in set(seg))
                if score >= decontam.RETRIEVED:
                    best[i] = max(best.get(i, 0), score)
        want.update((d, i, round(s, 6)) for i, s in best.items())
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontam.find_leaks(docs(ds), bench).collect())
    assert got == want and len(want) >= 16


def test_answers_are_split_off():
    assert decontam.split_item("Who was it?\nNobody") == ("Who was it?", "Nobody")
    assert decontam.split_item("One sentence. Another one.") == ("One sentence.", "Another one.")
    assert decontam.split_item("a b c d e f g h") == ("a b c d e f", "g h") and decontam.split_item("word") == ("word", "")


# --- 8 ---


def test_toxicity_on_held_out_rows(spark, docs, prose):
    rng = random.Random(6)
    every, labels = [], []
    for k in range(400):
        words = prose(80, k).split()
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(80)] = rng.choice(["idiotic", "moronic", "trashy"]) + rng.choice(["", "s", "est"])
        every.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    d, l = docs(every + ODD).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(d, toxicity.train(d, l)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(out[k]["held"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(400))
    test = [k for k in range(400) if out[k]["held"]]
    assert sum(out[k]["predicted"] == int(k % 4 == 0) for k in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["score"] == out[901]["score"]
    assert toxicity.score_toxicity(docs([]), toxicity.train(docs([]), l.limit(0))).count() == 0


def late_insults(spark, prose):
    """(texts, labels) in which the toxic rows beyond the first 4,000 by hash, and held-out ones, have an insult of their own."""
    n, few = 6_400, 8_000
    learnt = [r["id"] for r in spark.range(n).filter(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    early = set(learnt[:4_000])
    assert len(learnt) >= 4_500
    texts = [(k, prose(12, k) + ("" if k >= n else " qwfool" if k in early else " zorgle")) for k in range(n + few)]
    return texts, spark.createDataFrame([(k, 1, int(k < n)) for k in range(n + few)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("bounds", [{}, {"shard_terms": 50_000}])
def test_toxicity_is_learnt_from_every_labelled_row(spark, docs, prose, bounds):
    texts, labels = late_insults(spark, prose)
    d = docs(texts)
    m = toxicity.train(d, labels, **bounds)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, m).collect()}
    assert sum(out[k] == int(k < 6_400) for k, _ in texts) >= 0.999 * len(texts)
    again = toxicity.train(d.repartition(7), labels.repartition(3), **bounds)
    assert m.bias == again.bias and (m.weights == again.weights).all() and (m.factors == again.factors).all()


def test_toxicity_on_one_shard_by_plain_rows(spark, docs, prose):
    texts = [(k, prose(40, k) + (" idiotic" if k % 3 == 0 else "") + (" aye" if k % 4 < 2 else "") + (" nay" if k % 4 in (1, 2) else "")) for k in range(900)]
    toxic = lambda k: int(k % 3 == 0 or k % 4 in (1, 3))
    labels = spark.createDataFrame([(k, 1, toxic(k)) for k, _ in texts], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs(texts), labels)
    plain = []
    for k, t in texts:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            buf = np.frombuffer(t.encode(), np.uint8)
            plain.append((toxic(k), toxicity.terms(buf, np.array([0, len(buf)]))[1]))
    pos = sum(y for y, _ in plain)
    want = toxicity.fit(plain, (len(plain) - pos, pos))
    assert len(m.buckets) and m.buckets.tolist() == want.buckets.tolist() and m.bias == pytest.approx(want.bias, abs=1e-9)
    assert np.allclose(m.weights, want.weights, atol=1e-9) and np.allclose(m.factors, want.factors, atol=1e-9)


def test_machine_learns_a_pair_that_no_weight_shows():
    rng = np.random.default_rng(0)
    data = []
    for k in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        data.append((int(a and b), np.array([1] * a + [2] * b + [3 + int(rng.integers(0, 3))], np.int64)))
    m = toxicity.fit(data, (600, 200))
    text = np.array([0, 1, 1, 2]); bucket = np.array([1, 1, 2, 2])
    alone, both, other = m.scores(text, bucket, 3)
    assert both > 0.7 > 0.3 > max(alone, other)


def test_machine_selects_a_pair_that_no_weight_shows():
    """Toxic if both terms or neither: each alone says nothing."""
    rng = np.random.default_rng(1)
    data = []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        data.append((int(a == b), np.unique(np.concatenate([[1] * a, [2] * b, 3 + rng.integers(0, 400, 40)]).astype(np.int64))))
    m = toxicity.fit(data[:3000], (1500, 1500))
    assert {1, 2} <= set(m.buckets.tolist())
    right = 0
    for y, bucket in data[3000:]:
        own = bucket[np.isin(bucket, m.buckets)]
        right += (m.scores(np.zeros(len(own), int), own, 1)[0] >= 0.5) == y
    assert right >= 970


def test_toxicity_cases(spark, docs, prose):
    texts = [(k, prose(60, k) + (" idiotic moronic" if k % 3 == 0 else "")) for k in range(90)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k, _ in texts] * 2 + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    d = docs([*texts, *texts[:9], (500, " ".join(prose(5000, 3) for _ in range(40)) + " idiotic moronic"), *ODD])
    m = toxicity.train(d, labels)
    out = toxicity.score_toxicity(d, m).collect()
    assert len(out) == 90 + 9 + 1 + len(ODD) and all(len({r["score"] for r in out if r["doc_id"] == k}) == 1 for k in range(9))
    clean = toxicity.drop_toxic(d.withColumn("predicted", F.lit("clash")), m)
    assert clean.columns == [*d.columns, "predicted"] and rows(clean, "doc_id", "text") == sorted([(r["doc_id"], r["text"]) for r in out if r["predicted"] == 0], key=str)
    one_label = toxicity.train(d, labels.filter("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(d, one_label).collect())


# --- 9 ---

PAGE = """<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div id="side-bar" class="sidebar"><p>Side text that is long enough to look like content of a page.</p></div>
<article><h1>A  title </h1><p><b>First &amp; longest paragraph<br>of the article, with &eacute; and&nbsp;more words in it.<p>Tiny.</p><div class="ad">Buy</div><p>Last paragraph of the text, again with some words.</p></article>
<section class="comments"><article><p>A reader wrote a rather long comment about all of this, which is no part of it.</p></article></section><form><p>Your name</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "A title\nFirst & longest paragraph of the article, with é and more words in it.\nTiny.\nLast paragraph of the text, again with some words."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain  text"), (5, "u", "<p>cut off")], "page_id long, url string, html string")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract_text(pages).collect()}
    assert out[1] == (want, len(want)) and out[2] == out[3] == ("", 0) and out[4] == ("plain text", 10) and out[5][0] == "cut off"


def test_main_text_without_an_article():
    body = "".join(f"<p>{'words of a paragraph ' * 12}{k}.</p>" for k in range(4))
    html = f"<div class=menu><a href=x>One</a><a href=y>Two</a></div><div class=post><h2>Head</h2>{body}</div><div class='cookie-notice'>{'we use cookies ' * 20}</div>"
    got = htmltext.main_text(html).split("\n")
    assert got[0] == "Head" and len(got) == 5


def test_main_text_needs_the_clusters(monkeypatch):
    """Without classes or article elements the smoothed ratios alone tell the article from menus and notices."""
    text = "".join(f"<p>{'some words of a paragraph ' * 9}{k}.</p>" for k in range(5))
    menu = "<div><ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a> <span>{k}</span></li>" for k in range(30)) + "</ul></div>"
    html = f"<body>{menu}<div><h2>Head</h2>{text}</div>{menu}<div><p>small print</p></div></body>"
    got = htmltext.main_text(html).split("\n")
    assert got[0] == "Head" and len(got) == 6
    monkeypatch.setattr(htmltext, "clusters", lambda even: [(0, len(even))])
    monkeypatch.setattr(htmltext, "ratios", lambda lines: np.ones(len(lines)))
    assert htmltext.main_text(html).split("\n") != got


def test_smoothing_and_clusters_by_plain_loops():
    import math

    rng = random.Random(3)
    for _ in range(50):
        values = [rng.choice([0, 5, 80, 300]) for _ in range(rng.randint(1, 30))]
        want = []
        for i in range(len(values)):
            weights = {j: math.exp(-0.5 * (i - j) ** 2) for j in range(len(values)) if abs(i - j) <= 3}
            want.append(sum(w * values[j] for j, w in weights.items()) / sum(weights.values()))
        even = htmltext.smooth(np.array(values, float))
        assert even.tolist() == pytest.approx(want)
        cut = max(0.5 * float(np.std(even)), 1e-9)
        runs, at = [], None
        for i, x in enumerate([*even.tolist(), -1]):
            if x >= cut and at is None:
                at = i
            elif x < cut and at is not None:
                runs.append((at, i))
                at = None
        assert htmltext.clusters(even) == runs


def test_main_text_cases(spark):
    deep = "<div>" * 60_000 + "deep text" + "</span>" * 2000 + "</div>" * 60_000
    long = "<p>" + "word " * 400_000 + "</p>"
    cases = [(1, "u", PAGE), (1, "u", PAGE), (None, None, "<p>no id"), (2, "u", deep), (3, "u", long), (4, "u", "<nav>only a menu</nav>")]
    pages = spark.createDataFrame(cases, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(7)})
    out = htmltext.extract_text(pages).collect()
    by_id = {r["page_id"]: r for r in out}
    assert len(out) == 6 and out[0]["text"] == out[1]["text"] and by_id[None]["text"] == "no id"
    assert by_id[2]["text"] == "deep text" and by_id[3]["n_chars"] == 5 * 400_000 - 1 and by_id[4]["text"] == ""
    assert htmltext.extract_text(pages.limit(0)).count() == 0


# --- 10 ---


def test_token_files_round_trip(spark, docs, prose, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = [(k, prose(50 + 40 * k, k).title() + " it's 漢 ½") for k in (3, 1, 2)] + [(9, None), (8, ""), (7, "\x1ca <|endoftext|> b\x85c")]
    files = f"file://{tmp_path}/set"
    table = rans.write_tokens(docs(texts), files, path, end_id=1)
    out = {r["doc_id"]: r for r in rans.read_blocks(spark, files, table, keep_ids=True).collect()}
    at = 0
    for i, t in sorted(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (list(out[i]["ids"]), out[i]["start"], out[i]["n_tokens"]) == (ids, at, len(ids))
        assert out[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = f"file://{tmp_path}/none"
    assert rans.read_blocks(spark, empty, rans.write_tokens(docs([]), empty, path, end_id=1)).count() == 0


def test_token_files_are_read_without_the_writer(spark, docs, prose, tmp_path):
    import public_tokenizers

    path, files = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/set"
    table = rans.write_tokens(docs([(k, prose(200, k)) for k in range(4)]), files, path, end_id=1)
    fields = ("doc_id", "start", "n_tokens", "ids_crc32", "ids")
    assert rows(rans.read_blocks(spark.newSession(), files, keep_ids=True), *fields) == rows(rans.read_blocks(spark, files, table, keep_ids=True), *fields)
    version, scale, size, crc, raw = table.row()
    assert size == 49408 and np.array_equal(rans.Frequencies.of_row(version, scale, size, crc, raw).start, table.start)
    for wrong in ((version + 1, scale, size, crc, raw), (version, scale + 1, size, crc, raw), (version, scale, size - 1, crc, raw), (version, scale, size, crc ^ 1, raw)):
        with pytest.raises(ValueError):
            rans.Frequencies.of_row(*wrong)


def test_token_file_query_reads_added_tokens_like_the_library(spark, docs, prose, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one <|endoftext|> two", "one<|STARTOFTEXT|>two", "<|startoftext|>", "a\x1c<|endoftext|>\x85 漢", "<|endoftext|><|endoftext|> It's", "<|endof text|> |>", prose(30, 1)]
    docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    at = 0
    for r in sorted(rans.op10_token_files(spark, str(tmp_path)).collect()):
        ids = [*lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert 49407 in lib.encode(texts[0], add_special_tokens=False).ids


def test_every_latin_character_is_read_like_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, tok = Tokenizer.from_file(path), rans.WordTokenizer(path, added=True)
    texts = [t for c in map(chr, range(1, 0x260)) for t in (c, f"a{c}b", f"{c} x", f"1{c}", f"{c}'s")]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abcdeéßÉÑñ019 \n\t'.,!-_/<|>\x1c\x1f\x85\xa0İıǅſ½²sdmtlvreƁȺ") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t, raw in zip(texts, tok.encode(texts), strict=True):
        assert np.frombuffer(raw, tok.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_of_many_texts_at_once_are_those_of_the_pattern():
    import public_tokenizers
    import pyarrow as pa
    import regex

    tok = rans.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), added=True)
    rng = random.Random(4)
    texts = ["", "'", "s'", "s", "'", "ll 'l", "l'rex 'v", "e''s -'s 'm'd'll've", "\xa0é'S\x1c1½2", ""]
    texts += ["".join(rng.choice("abEÉß01½ \n'-.\x1c\x85\xa0stmdlrve") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = [regex.findall(rans._SPLIT, t.lower()) for t in texts]
    for rows in (texts, texts[:1], texts[:0]):
        pieces, first = tok.split(pa.array([None, *rows], pa.string())[1:])
        assert [pieces[i:j].to_pylist() for i, j in zip(first, first[1:])] == want[: len(rows)]
    seen = []
    tok._piece, one = lambda p: seen.append(p) or one(p), tok._piece
    ids = tok.encode(texts) + tok.encode(texts)
    assert ids[: len(texts)] == ids[len(texts) :] and len(seen) == len(set(seen)) == len({p for w in want for p in w})


def test_rans_blocks():
    rng = np.random.default_rng(5)
    counts = np.zeros(1000, np.int64)
    ids = (rng.zipf(1.3, 400_000) % 1000).astype(np.uint32)
    counts += np.bincount(ids, minlength=1000)
    freq = rans.Frequencies(counts)
    assert int(freq.freq.sum()) == 1 << rans.SCALE and int(freq.freq.min()) >= 1
    for n in (0, 1, rans.LANES - 1, rans.LANES, rans.LANES + 1, 400_000):
        row = rans.pack(ids[:n], np.array([n]), freq)
        back, lengths, _ = rans.unpack(**row, table_=freq)
        assert np.array_equal(back, ids[:n]) and lengths.tolist() == [n]
    step = rans.CHECKPOINT * rans.LANES
    assert np.array_equal(rans.decode_block(row["payload"], row["checkpoints"], 400_000, freq, first=1, last=2), ids[step : 2 * step])
    assert len(row["payload"]) < 400_000 * 2
    damaged = bytearray(row["payload"])
    damaged[100] ^= 1
    with pytest.raises(ValueError):
        rans.unpack(row["header"], row["lengths"], bytes(damaged), row["checkpoints"], freq)


def test_toxicity_scores_by_plain_loops(spark, docs, prose):
    """Every weight and every pair of factors, one by one."""
    texts = [(k, prose(30, k) + (" you utter qwfool" if k % 2 else "")) for k in range(80)] + [(200, ""), (201, None), (202, " ".join(prose(400, 9) for _ in range(20)))]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    d = docs(texts)
    m = toxicity.train(d, labels)
    place = {int(b): k for k, b in enumerate(m.buckets)}
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(d, m).collect()}
    for i, t in texts:
        buf = np.frombuffer((t or "").encode(), np.uint8)
        own = [place[b] for b in {int(x) for x in toxicity.terms(buf, np.array([0, len(buf)]))[1]} if b in place]
        z = m.bias + sum(m.weights[k] for k in own) + sum(float(m.factors[a] @ m.factors[b]) for n, a in enumerate(own) for b in own[:n])
        assert out[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
        assert out[i]["predicted"] == int(out[i]["score"] >= toxicity.THRESHOLD)
