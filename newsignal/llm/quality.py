"""Quality rules: log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import Workspace, table

#: Buckets of the two multinomials.
BITS = 17
BUCKETS = 1 << BITS
#: Bytes of a word's ending; see ``grams``.
EDGE = 3
#: Parts of the trusted rows; each is scored under the counts of the others when the threshold is fitted.
FOLDS = 2
#: The threshold never rejects more than this share of the trusted rows it was fitted on.
TRUSTED_LOSS = 0.002
#: Base rules: fewest words, and the largest share of words (in hundredths) in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CLASS = np.full(256, 4, np.uint64)  # other ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"-()")):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:] = 0


def base_features(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offs) - 1
    n_words = np.diff(first)
    points = (buf & 0xC0) != 0x80
    symbols = tk.per_text(_SYMBOL[buf], offs)
    points &= tk.NOT_SPACE[buf]
    chars = tk.per_text(points, offs)
    # Lines with a word, equal to an earlier one of the same text: all of them but one of each kind.
    ls, le = tk.line_spans(buf, offs)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[worded], le[worded]
    dup_lines = np.zeros(n, np.int64)
    if len(ls):
        text = np.searchsorted(offs, ls, side="right") - 1
        key = tk.span_hashes(buf, ls, le) ^ tk.mix(text.astype(np.uint64) + np.uint64(1))
        distinct = np.unique(key, return_index=True)[1]
        dup_lines = np.bincount(text, minlength=n) - np.bincount(text[distinct], minlength=n)
    repeated = np.zeros(n, np.int64)
    grams3, at = tk.windows(hashes, first, 3)
    if len(at):
        key = grams3 ^ tk.mix(tk.owners(at, first).astype(np.uint64) + np.uint64(1))
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = at[twice[place] == key]
            covered = np.zeros(len(hashes) + 1, bool)
            for k in range(3):
                covered[hit + k] = True
            total = np.concatenate([[0], np.cumsum(covered[:-1])])
            repeated = total[first[1:]] - total[first[:-1]]
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, word numbers) of the hashed n-grams of all texts.

    Words and pairs of neighbouring words.  As most pairs of a text were never seen before, both
    are also taken with less detail: a word's last ``EDGE`` bytes with its shape (the classes of its
    first and last byte, where case and symbols show), and pairs of shapes with lengths.
    """
    shift = np.uint64(64 - BITS)
    words = hashes >> shift
    two, beside = tk.windows(hashes, first, 2)
    tails = np.maximum(starts, ends - EDGE)
    shape = _CLASS[buf[starts]] * np.uint64(5) + _CLASS[buf[ends - 1]]
    tail = tk.mix(tk.span_hashes(buf, tails, ends) + shape * np.uint64(0x9E3779B97F4A7C15)) >> shift
    kind = shape * np.uint64(32) + np.minimum(ends - starts, 31).astype(np.uint64)
    pair, at = tk.windows(tk.mix(kind + np.uint64(77)), first, 2)
    every = np.arange(len(starts))
    return [(words.astype(np.int64), every), ((two >> shift).astype(np.int64), beside), (tail.astype(np.int64), every), ((pair >> shift).astype(np.int64), at)]


def _parse(buf: np.ndarray, offs: np.ndarray):
    starts, ends, first = tk.word_spans(buf, offs)
    return starts, ends, first, tk.span_hashes(buf, starts, ends)


@dataclass
class Ratio:
    """log p(bucket | trusted) - log p(bucket | raw) for each bucket, and the least mean a text is kept with.

    ``weights`` may have a row for each fold.
    """

    weights: np.ndarray
    threshold: float

    def means(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        """Log-likelihood ratio of each text (under the weights of its ``fold``), divided by its number of n-grams; 0 for a text without words."""
        n = len(first) - 1
        total, size = np.zeros(n), np.zeros(n)
        for bucket, at in grams(buf, starts, ends, first, hashes):
            text = tk.owners(at, first)
            total += np.bincount(text, self.weights[bucket] if fold is None else self.weights[fold[text], bucket], n)
            size += np.bincount(text, minlength=n)
        return total / np.maximum(size, 1)


def count_grams(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Bucket counts over all documents, and over those that ``trusted`` (doc_id, fold) names, by fold: an array of 1 + FOLDS rows."""
    # The trusted ids grow with the corpus, so both sides are shuffled at every size.
    marked = docs.select("doc_id", "text").join(trusted.select("doc_id", "fold").hint("merge"), "doc_id", "left").select("text", "fold")
    names = ["raw", *(f"fold{k}" for k in range(FOLDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 + FOLDS, BUCKETS), np.int64)
        for b in batches:
            fold = np.asarray(b.column("fold").fill_null(-1))
            for i, j, buf, offs in tk.slices(b.column("text")):
                starts, ends, first, hashes = _parse(buf, offs)
                for bucket, at in grams(buf, starts, ends, first, hashes):
                    counts[0] += np.bincount(bucket, minlength=BUCKETS)
                    own = fold[i:j][tk.owners(at, first)] if (fold[i:j] >= 0).any() else np.empty(0)
                    for k in range(FOLDS if len(own) else 0):
                        counts[1 + k] += np.bincount(bucket[own == k], minlength=BUCKETS)
        # A row for each bucket and task at most: summed before the shuffle, whatever the input.
        full = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(c[full]) for c in counts)], ["bucket", *names])

    sums = [F.sum(n).alias(n) for n in names]
    rows = marked.mapInArrow(tk.lean(run), "bucket long, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*sums).toArrow()
    out = np.zeros((1 + FOLDS, BUCKETS))
    for k, n in enumerate(names):
        out[k, rows.column("bucket").to_numpy()] = rows.column(n).to_numpy()
    return out


def ratio_weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the two multinomials; a corpus without trusted text has ratio 0 everywhere."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    p = (target + 1.0) / (target.sum() + BUCKETS)
    q = (raw + 1.0) / (raw.sum() + BUCKETS)
    return np.log(p) - np.log(q)


def best_threshold(scored: DataFrame) -> float:
    """The cut that tells good rows of (quality, mean) best from bad ones, in the middle of its gap, below which at most TRUSTED_LOSS of the good lie.

    Every row counts.  Distinct means are dealt out in ranges; what lies below a cut is the sum of
    the ranges before its own and a running sum inside it.
    """
    work = Workspace(scored.sparkSession, "thresholds")
    distinct = scored.groupBy("mean").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
    values = work.keep(distinct.repartitionByRange("mean").withColumn("range", F.spark_partition_id()), "means")
    good, bad, least = values.agg(F.sum("good"), F.sum("bad"), F.min(F.when(F.col("good") > 0, F.col("mean")))).first()
    if not good or not bad:
        work.drop_all_but()
        return least - 1e-9 if good else -np.inf
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = values.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    before = sums.select("range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("good", "bad")])
    inside = Window.partitionBy("range").orderBy("mean").rowsBetween(Window.unboundedPreceding, -1)
    lost, caught = (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}_before") for c in ("good", "bad"))
    cuts = values.join(F.broadcast(before), "range").select("mean", lost.alias("lost"), (caught / bad - lost / good).alias("gain"))
    best = cuts.filter(F.col("lost") <= int(TRUSTED_LOSS * good)).orderBy(F.desc("gain"), "mean").first()["mean"]
    below = values.filter(F.col("mean") < best).agg(F.max("mean")).first()[0]
    work.drop_all_but()
    return ((best - 1e-9 if below is None else below) + best) / 2


def fit(docs: DataFrame, labels: DataFrame) -> Ratio:
    """Counts over all documents and all trusted ones; the threshold from all labelled rows.

    The threshold is fitted out of sample: trusted rows are dealt over FOLDS by the hash of their
    doc_id, and a labelled row is scored under the counts of the other folds.  The result has the
    counts of all folds.  A doc_id with several labels is trusted if any of them is good; rows that
    share a doc_id count as one row of their mean score.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    rated = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = count_grams(docs, rated.filter("quality > 0").withColumn("fold", fold))
    target = counts[1:].sum(0)
    others = Ratio(np.stack([ratio_weights(counts[0], target - counts[1 + k]) for k in range(FOLDS)]), -np.inf)
    shared = docs.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in tk.slices(b.column("text")):
                parsed = _parse(buf, offs)
                passed = pa.array(~base_failed(base_features(buf, offs, *parsed)))
                mean = pa.array(shared.value.means(buf, *parsed, np.asarray(b.column("fold")[i:j])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], mean], ["doc_id", "mean"]).filter(passed)

    # Texts are scored where they lie: only ids and means meet the labels.
    means = docs.filter("doc_id is not null").select("doc_id", "text", fold.alias("fold")).mapInArrow(tk.lean(run), "doc_id long, mean double")
    scored = means.groupBy("doc_id").agg(F.avg("mean").alias("mean")).join(rated.hint("merge"), "doc_id").select("quality", "mean")
    threshold = best_threshold(scored)
    shared.destroy()
    return Ratio(ratio_weights(counts[0], target), threshold)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


_NEW = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("llr", T.DoubleType())]


def _rate(r: Ratio, texts: pa.Array) -> list[np.ndarray]:
    """The columns ``_NEW`` of some texts."""
    parts = []
    for _, _, buf, offs in tk.slices(texts):
        parsed = _parse(buf, offs)
        base = base_features(buf, offs, *parsed)
        failed, llr = base_failed(base), r.means(buf, *parsed)
        parts.append([*base.values(), failed, ~failed & (llr >= r.threshold), llr])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def drop_rejected(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are; cases as in ``rate_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    place = [n for n, _ in _NEW].index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, _ in tk.slices(b.column("text")):  # what goes back is never a second whole batch
                part = b[i:j]
                yield part.filter(pa.array(_rate(shared.value, part.column("text"))[place]))

    return docs.mapInArrow(tk.lean(run), docs.schema)


def rate_quality(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """``docs`` with the base features, base_failed, kept and llr (mean log-likelihood ratio) of the whole text.

    ``kept`` is false where the base rules fail, else true if llr reaches the threshold.

    Cases: a null or empty text has no words and so fails the base rules; a very long text is
    scored whole; a ratio just at the threshold is kept; repeated rows are rated alike; columns of
    the same names are replaced, all others stay; without trusted labels every text that passes the
    base rules is kept; an empty table stays empty.
    """
    docs = docs.drop(*[n for n, _ in _NEW])
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, _rate(shared.value, b.column("text")))], [*b.schema.names, *(n for n, _ in _NEW)])

    return docs.mapInArrow(tk.lean(run), T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in _NEW)]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate_quality(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
