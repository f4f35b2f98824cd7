"""The pipeline against a plain version of it, where there is one."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from newsignal.llm import bpe, quality, queries, toxicity
from newsignal.llm.shared import table

from .test_operators import brute_components, late_insults


def test_stages_against_a_plain_version(spark, small):
    import tiktoken

    docs = table(spark, small, "documents")
    labels = table(spark, small, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # The two trained stages: what their operators decide about the same rows.
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).filter("predicted = 1").collect()}
    rest = docs.filter(~docs["doc_id"].isin(list(toxic)))
    good = {r["doc_id"] for r in quality.rate_quality(rest, quality.fit(rest, labels)).filter("kept").collect()}
    first = {i for i, (_, c) in brute_components([(i, texts[i]) for i in sorted(good)]).items() if i == c}
    norm = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    items = [norm(r["text"]) for r in table(spark, small, "benchmark").collect()]
    kept = {i for i in first if not any(q in norm(texts[i]) for q in items)}
    path, pattern = bpe.public_vocabulary()
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.encoder(path, pattern).vocabulary.ranks, special_tokens={})
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: lib.encode_ordinary(texts[i]) for i in kept}


def test_stages_keep_columns_and_define_every_case(spark, docs, prose, tmp_path):
    """Nulls, empty texts, repeated rows, shared ids, clashing columns and empty tables, stage by stage."""
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(20), *range(1000, 1060)]] + [(k, 0, 1) for k in range(20, 30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 7777) + ". " + prose(8, 7778))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same = prose(200, 1)
    odd = [(None, prose(90, 50)), (None, prose(90, 50)), (900, None), (901, ""), (902, "few words"), (903, same), (903, same), (904, prose(100, 60)), (904, prose(100, 61))]
    texts = [(k, prose(100, k) + (" ### $$$ idiotic" if k >= 20 else "")) for k in range(30)]
    long = (905, " ".join(prose(3000, 70 + k) for k in range(40)))
    clash = {"score": F.lit("mine"), "predicted": F.lit(7), "kept": F.lit("mine"), "llr": F.lit(None).cast("string"), "n_words": F.lit(-1), "component_id": F.lit(3), "leaked": F.array(F.lit(1)), "tags": F.create_map(F.lit("a"), F.lit(1))}
    d = docs([*texts, *odd, long]).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        got = [tuple(r[c] for c in ("doc_id",)) for r in out.collect()]
        empty = stage(spark, d.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name == "byte-level BPE":
            assert len(got) == d.count()
            continue
        assert out.dtypes == d.dtypes and empty.columns == d.columns
        assert all(r["score"] == "mine" and r["n_words"] == -1 and r["tags"] == {"a": 1} for r in out.collect())
        ids = [i for (i,) in got]
        if name == "n-gram Jaccard join":
            assert ids.count(903) == 1 and ids.count(904) == 2 and ids.count(None) == 2 and {900, 901, 902, 905} <= set(ids)
            again = [r["text"] for r in stage(spark, d.repartition(3), str(tmp_path)).filter("doc_id = 904").collect()]
            assert again == [r["text"] for r in out.filter("doc_id = 904").collect()]
        elif name == "quality rules":
            assert not {900, 901, 902} & set(ids) and ids.count(None) in (0, 2)
        else:
            assert {900, 901, 902} <= set(ids) and ids.count(None) == 2 and ids.count(903) == 2 and 905 in ids


def test_near_copies_are_judged_by_row(spark, docs, prose, tmp_path):
    x, y, z = prose(60, 1), prose(60, 2), prose(60, 3)
    d = docs([(3, x), (5, x + " more"), (5, y), (7, y + " more"), (9, z), (9, x), (9, z)])
    out = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, d, str(tmp_path)).collect())
    assert out == sorted([(3, x), (5, y), (9, z)])


def test_the_quality_stage_hears_every_label(spark, docs, prose, tmp_path):
    n, few = 5_600, 3_000
    # Good rows beyond the first 5,000 by hash look like bad ones: a threshold from a sample by hash drops them all.
    late = {r["id"] for r in spark.range(n).orderBy(F.xxhash64("id")).tail(600)}
    d = docs([(k, prose(40, k) + " #a" * 12 if k in late or k >= n else prose(52, k)) for k in range(n + few)])
    spark.createDataFrame([(k, int(k < n), 0) for k in range(n + few)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_low_quality(spark, d, str(tmp_path)).select("doc_id").collect()}
    assert n - len([k for k in kept if k < n]) <= quality.TRUSTED_LOSS * n


def test_the_toxicity_stage_hears_every_label(spark, docs, prose, tmp_path):
    texts, labels = late_insults(spark, prose)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs(texts), str(tmp_path)).select("doc_id").collect()}
    # A machine that learns from the first 4,000 toxic rows by hash keeps all others.
    assert len([k for k in kept if k < 6_400]) <= 5 and len([k for k in kept if k >= 6_400]) >= 7_990


def test_the_encoding_stage_leaves_no_pieces_in_the_workers(spark, docs, prose, tmp_path):
    """Workers are used again by later stages, which need the memory."""
    import pyarrow as pa

    d = docs([(k, prose(200, k)) for k in range(40)]).repartition(4)
    assert corpus_pipeline.encode(spark, d, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] > 8_000
    vocabulary, bounds = bpe.public_vocabulary(), bpe.SMALL

    def left(batches):
        for b in batches:
            e = bpe.encoder(*vocabulary, *bounds)
            yield pa.RecordBatch.from_arrays([pa.array([len(e.cache) + len(e.older) + len(e.vocabulary.pairs) + len(e.vocabulary.older)])], ["n"])

    assert {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n long").collect()} == {0}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
