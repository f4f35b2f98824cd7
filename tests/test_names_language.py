"""The automaton of names and the language gate against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsignal.operators import entities, language
from newsignal.plans import kernels


@pytest.mark.parametrize("letters", [entities.LETTERS, 40])
def test_all_names_are_found_whole_texts(spark, monkeypatch, letters):
    monkeypatch.setattr(entities, "LETTERS", letters)
    monkeypatch.setattr(entities, "CHUNK", 3)
    rng = random.Random(2)
    names = ["aa", "aab", "b", "é", "😀a", "abc d", "nothing of it", "aa", ""]
    texts = [(k, "".join(rng.choice("aab é😀cd") for _ in range(rng.randrange(60)))) for k in range(40)] + [(7, "aaaaab"), (8, None), (9, ""), (None, "b aab")]
    got = entities.find_names(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), "id", F.col("body"))
    want = [(i, n, t.count(n), t.index(n) + 1) for i, t in texts if t for n in {*names} - {""} if n in t]
    assert got.columns == ["id", "name", "n", "first"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert entities.find_names(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([], "name string"), "id", F.col("body")).count() == 0


def test_places_of_own_names(spark):
    rows = [(1, "x", "abcab ab", ["ab", "c", "zz"]), (2, "y", None, ["a"]), (3, None, "é a é", ["é", "a"]), (4, "w", "text", None)]
    out = entities.places(spark.createDataFrame(rows, "id long, extra string, body string, own array<string>"), "body", "own")
    assert out.columns == ["id", "extra", "name", "n", "first"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "x", "ab", 3, 1), (1, "x", "c", 1, 3), (3, None, "é", 2, 1), (3, None, "a", 1, 3)]))


def test_language_scores_equal_plain_sums(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "la casa y el perro", "es"), (3, "le chat et la souris", "fr"), (4, "the house", "en"), (5, None, "en"), (6, "no language", None)]
    model = language.learn(spark.createDataFrame(rows, "id long, t string, l string"), "t", "l")
    counts = {}
    for _, t, l in rows:
        if t and l:
            for b in language.trigrams(t):
                counts[l, int(b)] = counts.get((l, int(b)), 0) + 1
    assert {(r["language"], r["bucket"]): r["n"] for r in model.collect()} == counts
    asked = [(1, "the dog and a cat"), (2, "el perro"), (3, "le chat"), (4, ""), (5, None), (6, "the")]
    out = {r["id"]: r for r in language.language_gate(spark.createDataFrame(asked, "id long, t string"), "t", ["en"], model).collect()}
    total = {l: language.BUCKETS + sum(n for (k, _), n in counts.items() if k == l) for l in ("en", "es", "fr")}
    for i, t in asked:
        if t:
            score = {l: sum(np.log((counts.get((l, int(b)), 0) + 1) / total[l]) for b in language.trigrams(t)) for l in total}
            assert out[i]["predicted"] == max(sorted(score), key=lambda l: score[l])
        else:
            assert out[i]["predicted"] is None
        assert out[i]["passes"]  # all are short
    long = spark.createDataFrame([(1, "el perro y la casa y el perro")], "id long, t string")
    assert not language.language_gate(long, "t", ["en"], model).first()["passes"]
    assert language.identify(long, "t", model.limit(0)).first()["predicted"] is None


def test_language_gate_on_rows_it_did_not_learn_from(spark, small):
    out = {r["doc_id"]: r for r in kernels.language_gate(spark, small).collect()}
    told = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert {i for i in out if zlib.crc32(str(i).encode()) % 4 == 2} == set(held) and len(out) == len(told)
    long = [i for i in held if len(told[i][1] or "") >= 200]
    assert np.mean([out[i]["predicted"] == told[i][0] for i in long]) >= 0.9
