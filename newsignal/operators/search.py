"""Text and vector search: BM25, nearest neighbours, votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that no search looks for.
STOPWORDS = (
    "the a an is are was were be been being and or but in on at to for of with by from as into about than this that these those it its has have had will would could should may might can do does did not no"
).split()
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(df: DataFrame, key: str, text) -> DataFrame:
    """(key, token) of words of three letters a-z or more, in lower case, without stopwords."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[a-z]{3,}$"))
    return df.select(key, F.explode(words).alias("token")).filter(~F.col("token").isin(STOPWORDS))


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, text, query_text, least: float, most: int) -> DataFrame:
    """(query, key, score) of the best documents of each query; a negative idf counts as a quarter of the mean idf.

    Statistics cover all documents; scores are only made for documents that share a token.
    """
    words = tokens(docs, key, text)
    tf = words.groupBy(key, "token").agg(F.count("*").alias("tf"))
    length = words.groupBy(key).agg(F.count("*").alias("dl"))
    corpus = docs.select(key).join(length, key, "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    idf = tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(corpus)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg((EPSILON * F.avg("idf")).alias("low"))
    idf = idf.join(F.broadcast(mean)).select("token", "avgdl", F.when(F.col("idf") < 0, F.col("low")).otherwise(F.col("idf")).alias("idf"))
    asked = tokens(queries, query_key, query_text).groupBy(query_key, "token").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = asked.join(idf, "token").join(tf, "token").join(length, key).groupBy(query_key, key).agg(F.round(F.sum(part), 9).alias("score")).filter(F.col("score") > least)  # rounded, so that equal texts tie
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).filter(F.col("rank") <= most)


#: Rows of one block of queries and of one block of the base, of which one task compares two.
QUERY_BLOCK, BASE_BLOCK = 1_024, 8_192


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, most: int, least: float = -1.0) -> DataFrame:
    """(src, dst, sim, rank): the most similar rows of ``base`` for each query, itself left out.

    Queries and base are dealt into blocks; a task multiplies two blocks and gives the best of
    each query, so nothing that grows is broadcast and no row of pairs is made.
    """
    nq, nb = _blocks(queries, QUERY_BLOCK), _blocks(base, BASE_BLOCK)
    q = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(nq)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("j"))
    b = base.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(nb)).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("i"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "sim": np.empty(0)})
        y = y.sort_values("id")
        src, dst, sim = x["id"].to_numpy(), y["id"].to_numpy(), _unit(x["v"]) @ _unit(y["v"]).T
        sim[src[:, None] == dst[None]] = -np.inf
        best = np.argsort(-sim, axis=1, kind="stable")[:, :most]
        out = pd.DataFrame({"src": np.repeat(src, best.shape[1]), "dst": dst[best].ravel(), "sim": np.take_along_axis(sim, best, 1).ravel()})
        return out[out["sim"] >= least]

    found = q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, "src long, dst long, sim double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))).filter(F.col("rank") <= most)


#: Rows of one block of queries and of one block of the base whose pairs one task makes, and queries at a time.
PAIR_BLOCK, STRIP = 2_048, 128


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists, of unit length; null ones and those with a null are 0."""
    lists = column.to_pylist()
    width = max((len(v) for v in lists if v is not None), default=0)
    m = np.array([v if v is not None and None not in v else [0.0] * width for v in lists], float).reshape(len(lists), width)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)


def blended_pairs(queries: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(a, b, blend) of every query with every row of the base that has another key: 0.35 of the cosine, 0.05 of shared over united words, 0.10 of how near the times are and 0.15 of the source, over their sum.

    Rows: ``key`` (long), v (vector), words (distinct 64-bit hashes), source (a hash or null) and at (microseconds).
    Queries and base are dealt into blocks, and a task makes the pairs of two blocks, so nothing that
    grows is broadcast and all that is shuffled is rows, not pairs.

    Cases: a vector without length and missing words count as 0, a missing source equals none.
    """
    nq, nb = _blocks(queries, PAIR_BLOCK), _blocks(base, PAIR_BLOCK)
    cols = [F.col(key).cast("long").alias("id"), *(F.col(c).alias(c) for c in ("v", "words", "source", "at"))]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = queries.select(*cols, F.pmod(F.xxhash64(key), F.lit(nq)).alias("i"), every(nb).alias("j"))
    y = base.select(*cols, F.pmod(F.xxhash64(key), F.lit(nb)).alias("j"), every(nq).alias("i"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("blend", pa.float64())])

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return schema.empty_table()
        a, b, u, v = *(t["id"].to_numpy() for t in (p, q)), *(_vectors(t["v"]) for t in (p, q))
        s, r = (t["source"].to_pylist() for t in (p, q))
        kinds = {k: n for n, k in enumerate({*s, *r} - {None})}
        s, r = np.array([kinds.get(k, -1) for k in s]), np.array([kinds.get(k, -2) for k in r])
        at, till = (t["at"].to_numpy() for t in (p, q))
        asked, words = ([w or [] for w in t["words"].to_pylist()] for t in (p, q))
        size, sizes = np.array([len(w) for w in asked]), np.array([len(w) for w in words])
        holders: dict[int, list[int]] = {}
        for k, ws in enumerate(words):
            for w in ws:
                holders.setdefault(w, []).append(k)
        lists = {w: np.array(holders[w]) for w in {w for ws in asked for w in ws} & holders.keys()}
        out = []
        for lo in range(0, len(a), STRIP):
            now = slice(lo, lo + STRIP)
            shared = np.zeros((len(a[now]), len(b)))
            for k, ws in enumerate(asked[now]):
                if found := [lists[w] for w in ws if w in lists]:
                    shared[k] = np.bincount(np.concatenate(found), minlength=len(b))
            lexical = shared / np.maximum(size[now][:, None] + sizes[None] - shared, 1)
            h = np.abs(at[now][:, None] - till[None]) / 3.6e9
            temporal = np.maximum(np.exp(-h * h / 128), np.exp(-h * h / 10368))
            source = np.where(s[now][:, None] == r[None], 0.3, 1.0)
            semantic = np.fmax(np.fmin(u[now] @ v.T, 1.0), 0.0)
            blend = (0.35 * semantic + 0.05 * lexical + 0.10 * temporal + 0.15 * source) / 0.65
            i, j = np.nonzero(a[now][:, None] != b[None])
            out.append(pa.RecordBatch.from_arrays([pa.array(a[now][i]), pa.array(b[j]), pa.array(blend[i, j])], schema=schema))
        return pa.Table.from_batches(out, schema)

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(run, "a long, b long, blend double")


#: Rows of one block of queries and of one block of the base whose lists of names meet in one task, and pairs that leave it together.
ASKED_BLOCK, HELD_BLOCK, PAIRS = 8_192, 32_768, 1 << 18


def sharing_pairs(queries: DataFrame, base: DataFrame, key: str, names: str) -> DataFrame:
    """(a, b, shared, n, m): every query with every row of the base that has another key and shares a name, how many names they share, and how many each has.

    ``names``: distinct 64-bit hashes.  Queries and base are dealt into blocks; a task looks up the
    names of one block in the lists of another and gives its pairs bit by bit, so rows are shuffled
    and not pairs, and no name, however common, takes more of a task than the pairs of two blocks.

    Cases: rows without names or without a key are in no pair; repeated keys are rows of their own.
    """
    nq, nb = _blocks(queries, ASKED_BLOCK), _blocks(base, HELD_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    of = lambda df, asked, i, j: df.filter(F.col(key).isNotNull() & (F.size(names) > 0)).select(F.col(key).cast("long").alias("id"), F.col(names).alias("names"), F.lit(asked).alias("asked"), i.alias("i"), j.alias("j"))
    rows = of(queries, True, own(nq), every(nb)).unionByName(of(base, False, every(nq), own(nb)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        if not whole.num_rows:
            return
        p, q = whole.filter(whole["asked"]).combine_chunks(), whole.filter(pc.invert(whole["asked"])).combine_chunks()
        if not p.num_rows or not q.num_rows:
            return
        a, b = p["id"].to_numpy(), q["id"].to_numpy()
        n, m = (pc.list_value_length(t["names"]).to_numpy().astype(np.int64) for t in (p, q))
        held, at = pc.list_flatten(q["names"]).to_numpy(), np.repeat(np.arange(len(b)), m)
        order = np.argsort(held, kind="stable")
        held, at = held[order], at[order]
        asked = pc.list_flatten(p["names"]).to_numpy()
        low, high = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
        ends, full, found = np.cumsum(n), 0, []
        for k in range(len(a)):
            hits = [at[lo:hi] for lo, hi in zip(low[ends[k] - n[k] : ends[k]], high[ends[k] - n[k] : ends[k]], strict=True) if lo < hi]
            if hits:
                rows_, shared = np.unique(np.concatenate(hits), return_counts=True)
                other = b[rows_] != a[k]
                rows_ = rows_[other]
                found.append((np.full(len(rows_), a[k]), b[rows_], shared[other], np.full(len(rows_), n[k]), m[rows_]))
                full += len(rows_)
            if full >= PAIRS or (k == len(a) - 1 and found):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)
                full, found = 0, []

    return rows.groupBy("i", "j").applyInArrow(run, "a long, b long, shared long, n long, m long")


def coherence(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, coherence, pairs): the mean cosine of all pairs of a group, negative ones counted as 0; a group of one is coherent.

    Groups are dealt into blocks, and cells of two blocks give sums.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / QUERY_BLOCK))
    dealt = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cells = dealt.select(F.col(group).alias("g"), F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", F.col(vector).alias("v"))

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        i, j, own = cell["i"].iloc[0], cell["j"].iloc[0], cell["_own"].to_numpy()
        unit = _unit(cell["v"])
        if i == j:
            sim = (unit @ unit.T)[np.triu_indices(len(unit), 1)]
        else:
            sim = (unit[own == i] @ unit[own == j].T).ravel()
        return pd.DataFrame({"g": [cell["g"].iloc[0]], "total": [float(np.maximum(sim, 0).sum())], "pairs": [len(sim)]})

    kind = dict(rows.dtypes)[group]
    sums = cells.groupBy("g", "i", "j").applyInPandas(run, f"g {kind}, total double, pairs long").groupBy(F.col("g").alias(group)).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return sums.select(group, F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(1.0).alias("coherence"), "pairs")


def mutual_edges(knn: DataFrame) -> DataFrame:
    """(src, dst, sim) with src < dst of neighbours of each other."""
    back = knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return knn.filter("src < dst and sim > 0").select("src", "dst", "sim").join(back, ["src", "dst"], "left_semi")


def vote(knn: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(src, label, score): the label with the largest sum of similarities, and the mean similarity of its votes."""
    votes = knn.join(labels.select(F.col(key).alias("dst"), F.col(label).alias("label")), "dst").groupBy("src", "label").agg(F.sum("sim").alias("total"), F.avg("sim").alias("score"))
    ranked = votes.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("total"), "label")))
    return ranked.filter("_r = 1").select("src", "label", "score")
