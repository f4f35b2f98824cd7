"""Every query with SQL against DuckDB on the smallest tables, and properties of operators on made-up rows."""

import datetime
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from newsignal.functions import text as T
from newsignal.operators import dedup, learning, rank, search, store
from newsignal.plans import catalog, kernels, leads, signals, stories  # noqa: F401  the others add their queries to the catalog
from newsignal.plans import runs as plans_runs
from newsignal.sources.tables import first_nonempty, latest_complete, read_log

from .cases import business, runs, sheets, tables  # noqa: F401  the others add their cases
from .cases import stories as story_cases  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    said = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in said.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(tables.CASES))
def test_rules_on_small_tables(spark, name):
    make, sql = tables.CASES[name]
    got = make(spark)
    cols = sorted(got.columns)
    said = duckdb.connect().execute(sql)
    names = [x[0] for x in said.description]
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str) == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in said.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_dedup_keeps_the_earliest_and_never_grows(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "b", 5), (4, None, 1)], "id int, k string, at int")
    out = rank.first_of(rows, ["k"], [F.col("at"), F.col("id")])
    assert {r["id"] for r in out.collect()} == {2, 3, 4}


def test_fail_open_takes_the_best_when_none_passes(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.3)], "id int, s double")
    assert {r["id"] for r in rank.fail_open(rows, F.col("s") > 0.9, [F.desc("s")], 2).collect()} == {2, 3}
    assert {r["id"] for r in rank.fail_open(rows, F.col("s") > 0.4, [F.desc("s")], 2).collect()} == {2}
    assert rank.fail_open(rows.limit(0), F.col("s") > 0.4, [F.desc("s")], 2).count() == 0


def test_similar_pairs_are_exact(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta gamma", "other words here now", "the the the the", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["a"], r["b"]): r["cosine"] for r in dedup.similar_pairs(docs, "id", F.col("text"), 0.5).collect()}
    assert got == pytest.approx({k: v for k, v in plain_cosines(dict(enumerate(texts))).items() if v >= 0.5})


def plain_cosines(texts):
    """TF-IDF cosines of all pairs of texts by plain loops."""
    tokens = {}
    for i, t in texts.items():
        w = re.findall(r"\w{2,}", (t or "").lower())
        tokens[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in tokens.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    weight = {i: {t: n * idf[t] for t, n in c.items()} for i, c in tokens.items()}
    norm = {i: math.sqrt(sum(x * x for x in w.values())) or 1.0 for i, w in weight.items()}
    return {(a, b): sum(x * weight[b].get(t, 0) for t, x in weight[a].items()) / norm[a] / norm[b] for a in texts for b in texts if a < b}


def plain_greedy(texts, least):
    """Keys that stay: equal texts once, then the earlier of two similar ones."""
    once = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        once.setdefault(t, i)
    cos, stay = plain_cosines({i: t for t, i in once.items()}), []
    for i in sorted(once.values()):
        if not any(cos[a, i] >= least for a in stay):
            stay.append(i)
    return set(stay)


def noisy_texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    bases = [[rng.choice(words) for _ in range(rng.randint(5, 40))] for _ in range(n // 6)]
    out = []
    for k in range(n):
        w = rng.choice(bases)[:]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("cap, least", [(32, 0.7), (1, 0.7), (2, 0.5), (3, 0.85)])
def test_near_duplicates_equal_a_plain_greedy_pass(spark, monkeypatch, cap, least):
    monkeypatch.setattr(dedup.similar_losers, "__defaults__", (cap,))
    monkeypatch.setattr(dedup, "CHUNK", 7)
    texts = [*noisy_texts(cap, 90), (200, ""), (201, None), (202, ""), (203, None), (204, "same words"), (205, "same words"), (206, "a b c")]
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("t", F.lit("clash"))
    got = dedup.drop_near_duplicates(docs, "id", F.col("text"), least)
    assert got.columns == ["id", "text", "t"] and {r["id"] for r in got.collect()} == plain_greedy(texts, least)
    assert dedup.drop_near_duplicates(docs.limit(0), "id", F.col("text"), least).count() == 0


def test_many_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"word{k}" for k in range(400)]
    texts = []
    for k in range(500):
        w = base[:]
        w[rng.randrange(400)] = f"own{k}"
        texts.append((k, " ".join(w)))
    made = []
    plain = dedup.meeting_pairs
    monkeypatch.setattr(dedup, "meeting_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    docs = spark.createDataFrame(texts, "id long, text string")
    work = store.Scratch(spark)
    lost = dedup.similar_losers(dedup.vectors(docs, "id", F.col("text"), work), 0.7, work)
    assert {r["id"] for r in lost.collect()} == set(range(1, 500))
    assert sum(m.count() for m in made) < 500 * dedup.CAP  # all pairs are 124,750


def test_merge_lists_looks_at_every_key(spark):
    a = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t2")], "id int, url string, title string")
    b = spark.createDataFrame([(3, "u1", "t9"), (4, "u9", "t2"), (5, "u5", "t5")], "id int, url string, title string")
    out = dedup.merge_lists(a, b, [F.col("url"), F.col("title")], [F.col("id")], 10)
    assert [r["id"] for r in out.collect()] == [1, 2, 5]


def test_folds(spark):
    runs = spark.createDataFrame([("x", k, v, 5.0) for k, v in enumerate([0.2, 0.9, 0.9, 0.1])], "k string, run int, reward double, weight double")
    row = learning.history(runs, "k", "run", "reward", "weight").select(
        learning.ema(F.col("runs"), "reward", 0.5, 0.0).alias("e"), learning.cusum_low(F.col("runs"), "reward", 0.4, 0.05).alias("c"), learning.beta_posterior(F.col("runs"), "reward", "weight").alias("p")
    ).first()
    e = c = 0.0
    for v in [0.2, 0.9, 0.9, 0.1]:
        e, c = e + 0.5 * (v - e), max(0.0, c + 0.35 - v)
    assert row["e"] == pytest.approx(e) and row["c"] == pytest.approx(c)
    assert 0 < row["p"]["alpha"] / (row["p"]["alpha"] + row["p"]["beta"]) < 1


def test_store_merge_and_upsert(spark):
    old = spark.createDataFrame([("Acme", "tools", 1.0), ("Bolt", "", 2.0)], "name string, industry string, size double")
    new = spark.createDataFrame([("ACME", "", 5.0), ("Cog", "x", None), ("Z", "one letter", 1.0)], "name string, industry string, size double")
    got = {r["name"]: (r["industry"], r["size"]) for r in store.smart_merge(old, new, "name", ["industry"], ["size"]).collect()}
    assert got == {"Acme": ("tools", 5.0), "Bolt": ("", 2.0), "Cog": ("x", None)}
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, s string")
    assert {(r["k"], r["s"]) for r in store.upsert(versions, versions.limit(0), "k", "v").collect()} == {("a", "y"), ("b", "z")}


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(T.guess_domain(F.lit("Acme Tools Pvt Ltd"))) == "acmetools.com"
    assert pick(T.guess_domain(F.lit("!"))) is None
    assert pick(T.same_company(F.lit("Acme Ltd"), F.lit("ACME Limited"))) is True
    assert pick(T.source_of_title(F.lit("A - b - Daily News"))) == "Daily News"
    assert pick(T.valid_email(F.lit("a.b@c.example.org"))) and not pick(T.valid_email(F.lit("a@b")))
    assert pick(T.domain(F.lit("nothing"))) == "unknown"
    assert pick(T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_search_leaves_the_query_itself_out(spark):
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id int, v array<double>")
    knn = search.neighbours(e.filter("id = 0"), e, "id", "v", 2)
    assert [r["dst"] for r in knn.orderBy("rank").collect()] == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"timestamp": "1", "x": 1}\nnot json\n{"timestamp": "3", "x": 3}\n{"timestamp": "2", "x": 2}\n')
    rows = read_log(spark, str(tmp_path / "log.json"), "timestamp string, x int", last=2)
    assert [r["x"] for r in rows.collect()] == [3, 2]
    runs = spark.createDataFrame([("a", 5, "3"), ("b", 6, "1"), ("c", 8, "2")], "id string, step_count int, recorded_at string")
    assert latest_complete(runs).first()["id"] == "c"
    assert first_nonempty([runs.limit(0), runs.filter("id = 'a'"), runs]).count() == 1


def test_names_and_answers(spark):
    from newsignal.functions import names

    pick = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for said in ('Sure:\n```json\n{"a": 1, "b": [1, 2]}\n```', '{"a": 1, "b": [1, 2', 'x {"a": 1, "b": [1, 2],'):
        got = pick(names.answer(F.lit(said), "a int, b array<int>"))
        assert (got["a"], list(got["b"])) == (1, [1, 2])
    assert pick(names.answer(F.lit("no object"), "a int, b array<int>")) is None or pick(names.answer(F.lit("no object"), "a int, b array<int>"))["a"] is None


def test_balanced_labels_keep_texts_with_one_opening(spark, tmp_path):
    opening = "same header " * 50
    texts = [opening + "first", opening + "second", opening + "first", "short", "other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(tuple(r) for r in catalog.QUERIES["balanced_labels"](spark, str(tmp_path)).collect()) == [(0, 1), (1, 1), (3, 0), (4, 0)]


def test_auto_labels_have_no_other_cap(spark):
    # 12,000 sure documents against 5,800 rejected ones: each text once, then twice the smaller class.
    rows = spark.range(18000).select("id", F.when(F.col("id") < 12000, F.concat(F.lit("good "), "id")).otherwise(F.concat(F.lit("bad "), F.greatest("id", F.lit(12200)))).alias("text"), F.when(F.col("id") < 12000, 0.95).otherwise(0.1).alias("score"), (F.col("id") >= 12000).alias("rejected"))
    got = {r["label"]: (r["n"], r["top"]) for r in plans_runs.auto_labels(rows).groupBy("label").agg(F.count("*").alias("n"), F.max("id").alias("top")).collect()}
    assert got == {1: (11600, 11599), 0: (5800, 17999)}


def test_smallest_keys_of_groups(spark):
    random.seed(5)
    for most in (0, 1, 7, 500, 2000):
        rows = [("a", random.choice([-(2**62), 0, 2**62]) + random.randrange(9000)) for _ in range(1000)] + [("b", 3)] * 900 + [("c", k) for k in range(5)]
        got = rank.smallest(spark.createDataFrame(rows, "g string, k long"), "g", "k", most, store.Scratch(spark)).collect()
        assert sorted(map(tuple, got)) == sorted(x for g in "abc" for x in sorted(r for r in rows if r[0] == g)[:most])


def test_blended_pairs_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIR_BLOCK", 4)
    monkeypatch.setattr(search, "STRIP", 2)
    random.seed(3)
    rows = [(k, random.choice([None, [0.0] * 3, [random.gauss(0, 1) for _ in range(3)]]) if k % 3 == 0 else [random.gauss(0, 1) for _ in range(3)], None if k == 7 else random.sample(range(9), k % 6), None if k % 5 == 0 else k % 4, k * 3_600_000_000 * random.randrange(40)) for k in range(20)]
    rows += [rows[2], rows[11]]
    df = spark.createDataFrame(rows, "id long, v array<double>, words array<long>, source long, at long")

    def blend(x, y):
        n = lambda v: math.sqrt(sum(t * t for t in v or []))
        semantic = max(0, min(1, sum(s * t for s, t in zip(x[1], y[1])) / n(x[1]) / n(y[1]))) if n(x[1]) and n(y[1]) else 0
        w, z = set(x[2] or []), set(y[2] or [])
        h = abs(x[4] - y[4]) / 3.6e9
        return (0.35 * semantic + 0.05 * (len(w & z) / len(w | z) if w | z else 0) + 0.10 * max(math.exp(-h * h / 128), math.exp(-h * h / 10368)) + 0.15 * (0.3 if x[3] is not None and x[3] == y[3] else 1)) / 0.65

    want = sorted((x[0], y[0], blend(x, y)) for x in rows if x[0] % 2 == 0 for y in rows if x[0] != y[0])
    got = sorted(map(tuple, search.blended_pairs(df.filter("id % 2 = 0"), df, "id").collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)


def test_kept_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = store.Scratch(spark).keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7
    assert not files() - before


def test_few_pairs_that_are_not_similar_are_compared(spark):
    texts = dict(noisy_texts(8, 240))
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").groupBy("text").agg(F.min("id").alias("id"))
    texts = {r["id"]: r["text"] for r in docs.collect()}
    work = store.Scratch(spark)
    vecs = dedup.vectors(docs, "id", F.col("text"), work)
    first = work.keep(dedup.prefixes(vecs, 0.7))
    more = (dedup.profiles(vecs, 0.7),) if hasattr(dedup, "profiles") else ()
    met = {(r["a"], r["b"]) for r in dedup.meeting_pairs(first, first, 0.7, *more).collect()}
    true = {k for k, v in plain_cosines(texts).items() if v >= 0.7}
    assert true <= met and len(met) < 1.5 * len(true), (len(met), len(true))


def test_sharing_pairs_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(search, "ASKED_BLOCK", 5)
    monkeypatch.setattr(search, "HELD_BLOCK", 7)
    monkeypatch.setattr(search, "PAIRS", 11)
    random.seed(6)
    rows = [(k, None if k == 9 else [1] * (k % 3 > 0) + random.sample(range(2, 30), k % 7)) for k in range(40)]
    rows += [(None, [1, 2, 3]), rows[4], rows[10]]
    df = spark.createDataFrame(rows, "id long, names array<long>")
    want = [(x[0], y[0], len({*x[1]} & {*y[1]}), len(x[1]), len(y[1])) for x in rows for y in rows if None not in (*x, *y) and x[0] % 2 == 0 and x[0] != y[0] and {*x[1]} & {*y[1]}]
    found = search.sharing_pairs(df.filter("id % 2 = 0"), df, "id", "names")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert search.sharing_pairs(df.limit(0), df, "id", "names").count() == 0
