"""Periodic runs, line deduplication and fill-in-the-middle: brute force, SQL, round trips, and the cases that docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsignal.llm import infill, lines, runs

ODD = [(None, "a b a b a b a b a b a b"), (None, None), (900, None), (901, ""), (902, " \t\n"), (903, "same row"), (903, "same row"), (903, "x y " * 9)]
CLASH = ("n", "row", "form", "n_words", "pos", "period", "output", "keep")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---


def brute_runs(w, least=12):
    """Every maximal stretch of every period, by plain loops; the smallest period of each."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(text, least=12):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute_runs(w, least)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(w), [tuple(r) for r in found], " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed, count, most=90):
    rng = random.Random(seed)
    out = []
    for k in range(count):
        words = [rng.choice("ab" if k % 3 == 0 else "abcdefgh") for _ in range(rng.randrange(most))]
        for _ in range(rng.randrange(4)):
            at, unit = rng.randrange(len(words) + 1), [rng.choice("xyzé") for _ in range(rng.randint(1, 9))]
            words[at:at] = (unit * 12)[: rng.randint(1, 40)]
        out.append((k, rng.choice([" ", "\n", " \t"]).join(words) + rng.choice(["", " "])))
    return out


@pytest.mark.parametrize("least, cost", [(12, runs.RANGE_COST), (12, 500), (5, 60), (1, 200)])
def test_runs_equal_plain_loops(spark, docs, least, cost):
    texts = [*periodic_texts(least, 120), *ODD]
    got = runs.find_runs(docs(texts).withColumns({c: F.lit("clash") for c in CLASH}), least, cost).collect()
    as_rows = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str)
    assert as_rows == sorted(((i, *brute_row(t, least)) for i, t in texts), key=str)


def test_runs_of_long_texts_and_small_blocks(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 700)
    rng = np.random.default_rng(3)
    for ids in (np.zeros(300, np.int32), np.tile(np.arange(7, dtype=np.int32), 60), rng.integers(0, 2, 400).astype(np.int32), np.concatenate([rng.integers(0, 9, 150), np.tile(rng.integers(0, 9, 31), 5)]).astype(np.int32)):
        found = runs.smallest_periods(runs.scan(ids, 1, len(ids)))
        assert [tuple(r) for r in found.tolist()] == brute_runs(ids.tolist())
        cut = [runs.scan(ids, low, low + 13) for low in range(1, len(ids), 13)]
        assert np.array_equal(runs.smallest_periods(np.concatenate(cut)), found)


def test_planted_runs_follow_the_rule(spark, docs):
    words = [f"w{i}" for i in range(40)]
    texts = [(k, " ".join(words)) for k in range(200)] + [(None, "a b"), (5, None), (6, "")]
    for r in runs.with_planted_runs(docs(texts)).collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is None or h % 10 or not r["text"]:
            assert (r["doc_id"], r["text"]) in texts
            continue
        g, n = h // 10, 40
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"].split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, small):
    got = {r["doc_id"]: r for r in runs.op11_periodic_runs(spark, small).collect()}
    planted = runs.with_planted_runs(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert len(got) == len(planted) and any(r["n_runs"] for r in got.values())
    for r in planted:
        if len((r["text"] or "").split()) > 1500:
            continue  # plain loops take the square
        _, found, collapsed = brute_row(r["text"])
        best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None,) * 3
        out = got[r["doc_id"]]
        assert (out["n_runs"], out["start"], out["length"], out["period"]) == (len(found), *best)
        assert out["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert out["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and out["collapsed_sha256"] == sha(collapsed)


def test_runs_of_nothing(spark, docs):
    assert runs.find_runs(docs([])).count() == 0


# --- 12 ---


def brute_lines(texts, chars=40, many=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars and i is not None:
                holders[key(x)].add(i)
    out = []
    for i, t in texts:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holders[key(x)]) < many or i == max(holders[key(x)])]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def repeating_texts(seed, count):
    rng = random.Random(seed)
    common = [f"Line number {k} é, which is long enough to be compared across documents" for k in range(12)]
    out = []
    for k in range(count):
        own = [rng.choice([*common, f"a line of document {k} alone, also long enough to be compared", "short", "", "  "]) for _ in range(rng.randrange(9))]
        own = [x.upper() if rng.random() < 0.2 else "\t" + x + " " if rng.random() < 0.2 else x for x in own]
        out.append((rng.choice([k, k % 7]), "\n".join([common[0], *own]) + rng.choice(["", "\n"])))
    return out


@pytest.mark.parametrize("hot", [1024, 1, 10**9])
def test_lines_equal_plain_loops(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    texts = [*repeating_texts(4, 150), *ODD, *repeating_texts(4, 10)[:3], (None, repeating_texts(4, 1)[0][1]), (77, "\n".join(f"line {k} of a very long document, each of them long enough" for k in range(4000)))]
    d = docs(texts).withColumns({c: F.lit("clash") for c in CLASH})
    maps = lines.line_bitmaps(d)
    got = sorted((tuple(r) for r in lines.apply_bitmaps(d, maps).collect()), key=str)
    assert got == brute_lines(texts)
    for r in maps.collect():
        assert sum(r["keep"]) == r["n_lines"] and sum(r["keep"][1::2]) == r["n_dropped"]


def test_line_bitmaps_are_run_lengths(spark):
    row = spark.range(1).select(F.lit(9).alias("n"), F.array(*[F.lit(x) for x in (0, 1, 4, 8)]).alias("gone"))
    found = row.select(lines.keep_runs(F.col("n"), F.col("gone")).alias("keep")).select("keep", lines.expanded(F.col("keep")).alias("mask")).first()
    assert found["keep"] == [0, 2, 2, 1, 3, 1, 0] and found["mask"] == [k not in (0, 1, 4, 8) for k in range(9)]


def test_lines_of_nothing_and_native_plan(spark, docs, small, capsys):
    assert lines.apply_bitmaps(docs([]), lines.line_bitmaps(docs([]))).count() == 0
    lines.op12_line_dedup(spark, small).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# --- 13 ---


def plain_fim(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate, slice_", [(100, 4 << 20), (60, 300)])
def test_infill_equals_a_plain_version(spark, docs, monkeypatch, rate, slice_):
    monkeypatch.setattr(infill, "SLICE", slice_)
    rng = random.Random(2)
    texts = [(k, "".join(rng.choice(["ab", "é😀", "\n", "\n\n", "\r\n", " <", "<S", ">", "\x00", "'"]) for _ in range(rng.randrange(40)))) for k in range(300)]
    texts += [*ODD, (1, "has <P> in it\n"), (2, "<M>"), (3, "x\n" * 50_000)]
    got = infill.fill_in_middle(docs(texts).withColumns({c: F.lit("clash") for c in CLASH}), rate=rate)
    back = got.withColumn("text", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back), key=str) == sorted(((i, *plain_fim(i, t, rate)) for i, t in texts), key=str)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in texts)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_infill_of_nothing(spark, docs):
    assert infill.fill_in_middle(docs([])).count() == 0


@pytest.mark.parametrize("op, sql", [(lines.op12_line_dedup, lines.ORACLE_SQL), (infill.op13_fill_in_middle, infill.ORACLE_SQL)])
def test_queries_equal_their_sql(spark, small, op, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = op(spark, small)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
