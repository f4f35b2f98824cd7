"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import Workspace, table

#: Hash space of terms, rank of the interactions, and the verdict's threshold.
BITS, RANK, THRESHOLD = 18, 4, 0.3
SIZE = 1 << BITS
#: Terms of one shard of the training rows, about: what one task learns from between two meetings.
SHARD_TERMS = 1 << 22
#: Training: passes over all rows, rows of a step, rate and decay.
EPOCHS, BATCH, RATE, L2 = 20, 256, 0.15, 1e-4
#: A term is a word, or its first so many bytes: compounds share their beginning.
PREFIXES = (4, 5, 6, 7)
#: A bucket takes part if its counts in the two labels differ by so many standard deviations, or the counts of a pair that it is in.
LEAST_Z, LEAST_DOCS, LEAST_PAIR_Z = 4.0, 3, 8.0
#: Pairs are tried among so many buckets, those that split the rows most evenly.
PAIRED = 2048
#: Rows of the matrix of pairs that are summed together, and the unit in which machines are averaged (whole numbers, so the order of sums is no matter).
PART, UNIT = 64, 2.0**-40

#: Letters, digits and all bytes beyond ASCII; case is folded for A-Z.
_LETTERS = np.zeros(256, dtype=bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _LETTERS[ord(_a) : ord(_b) + 1] = True
_LETTERS[0x80:] = True


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(buf: np.ndarray, offs: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct terms of each text; only ``chosen`` buckets if given."""
    starts, ends, first = tk.word_spans(buf, offs, _LETTERS)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(first))
    keys = []
    for k in (None, *PREFIXES):
        longer = slice(None) if k is None else np.flatnonzero(ends - starts > k)
        s, e = starts[longer], ends[longer] if k is None else starts[longer] + k
        h = tk.span_hashes(buf, s, e, tk.FOLDED)
        if k is not None:
            h = tk.mix(h + np.uint64(k))
        bucket = h >> np.uint64(64 - BITS)
        if chosen is not None:
            on = chosen[bucket]
            keys.append((text[longer][on] << np.uint64(BITS)) | bucket[on])
        else:
            keys.append((text[longer] << np.uint64(BITS)) | bucket)
    keys = np.unique(np.concatenate(keys))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64(SIZE - 1)).astype(np.int64)


def least_passages(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The smallest hash of the five-word passages of each text, which near copies mostly share; -1 where there is none."""
    starts, ends, first = tk.word_spans(buf, offs, _LETTERS)
    least = np.full(len(offs) - 1, ~np.uint64(0))
    if len(starts):
        passages, at = tk.windows(tk.span_hashes(buf, starts, ends, tk.FOLDED), first, 5)
        np.minimum.at(least, tk.owners(at, first), passages)
    return least.view(np.int64)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise inner products of factors) over the chosen buckets that a text has."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.buckets, bucket)
        z = self.bias + np.bincount(text, self.weights[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            z += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _z(toxic: np.ndarray, clean: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """How many standard deviations the shares of the two labels with a feature differ."""
    p, q = (toxic + 0.5) / (pos + 1), (clean + 0.5) / (neg + 1)
    shared = (toxic + clean + 1) / (pos + neg + 2)
    return (p - q) / np.sqrt(np.maximum(shared * (1 - shared), 1e-9) * (1 / pos + 1 / neg))


@dataclass
class Shard:
    """Some training rows: their labels, and the terms of row k in ``flat[offs[k] : offs[k + 1]]``."""

    y: np.ndarray
    flat: np.ndarray
    offs: np.ndarray

    def placed(self, buckets: np.ndarray) -> Shard:
        """The same rows with the places of their terms in ``buckets``; terms that have none are left out."""
        place = np.full(SIZE, -1)
        place[buckets] = np.arange(len(buckets))
        at = place[self.flat]
        total = np.concatenate([[0], np.cumsum(at >= 0)])
        return Shard(self.y, at[at >= 0], total[self.offs])


def telling_terms(seen: np.ndarray, rows: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets that tell the labels apart, buckets to try pairs of, how well each of these does alone); ``seen``: rows with each bucket, by label."""
    z = np.abs(_z(seen[1], seen[0], rows[1], rows[0]))
    both = seen.sum(0)
    share = both / sum(rows)
    some = np.argsort(-(share * (1 - share)), kind="stable")[:PAIRED]
    some = np.sort(some[both[some] >= LEAST_DOCS])
    return np.flatnonzero((z >= LEAST_Z) & (both >= LEAST_DOCS)), some, z[some]


def joint_counts(shard: Shard, width: int, both: np.ndarray | None = None) -> np.ndarray:
    """How many rows of each label have both of two places; added to ``both`` if given."""
    both = np.zeros((2, width, width), np.int32) if both is None else both
    for label in (0, 1):
        own = np.flatnonzero(shard.y == label)
        for lo in range(0, len(own), 1024):
            block = np.zeros((min(1024, len(own) - lo), width), np.float32)
            for k, i in enumerate(own[lo : lo + 1024]):
                block[k, shard.flat[shard.offs[i] : shard.offs[i + 1]]] = 1
            np.add(both[label], block.T @ block, out=both[label], casting="unsafe")  # whole numbers up to 1024
    return both


def telling_pairs(both: np.ndarray, lo: int, alone: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """The places of pairs that tell the labels apart, and do so better than either place alone: they may say nothing by themselves.

    ``both`` has the joint counts of the places from ``lo`` on, a row each, with all places from ``lo`` on.
    """
    found = np.zeros(len(alone), bool)
    for k in range(both.shape[1]):
        pair = np.abs(_z(both[1, k], both[0, k], rows[1], rows[0]))
        hit = (pair >= LEAST_PAIR_Z) & (pair >= np.maximum(alone[lo:], alone[lo + k]) + 2) & (both[0, k] + both[1, k] >= LEAST_DOCS)
        hit[k] = False
        found[lo:] |= hit
        found[lo + k] |= hit.any()
    return np.flatnonzero(found)


def _start(n: int, totals: tuple[int, int]) -> np.ndarray:
    """State of an untrained machine: a row for each place and one for the bias; weight, factors, and AdaGrad's sums of both."""
    prior = (totals[1] + 0.5) / (sum(totals) + 1.0)
    state = np.full((n + 1, 2 + 2 * RANK), 1e-6)
    state[:, 0] = 0
    state[:, 1 : 1 + RANK] = np.random.default_rng(7).normal(0, 0.01, (n + 1, RANK))
    state[n, 0] = np.log(prior / (1 - prior))
    return state


def _machine(buckets: np.ndarray, state: np.ndarray) -> Machine:
    return Machine(float(state[-1, 0]), buckets, state[:-1, 0].copy(), state[:-1, 1 : 1 + RANK].copy())


def _weights(rows: tuple[int, int], totals: tuple[int, int]) -> np.ndarray:
    """What a row of each label counts, 1 on average."""
    return np.array([totals[k] / rows[k] for k in (0, 1)]) * sum(rows) / sum(totals)


def epoch(state: np.ndarray, shard: Shard, weights: np.ndarray, seed: tuple[int, int], rate: float = RATE, l2: float = L2) -> np.ndarray:
    """``state`` after one pass of AdaGrad over the rows of a shard of places."""
    n = len(state) - 1
    w, v, gw, gv = state[:n, 0].copy(), state[:n, 1 : 1 + RANK].copy(), state[:n, 1 + RANK].copy(), state[:n, 2 + RANK :].copy()
    b, gb = state[n, 0], state[n, 1 + RANK]
    order = np.random.default_rng(seed).permutation(len(shard.y))
    for lo in range(0, len(order), BATCH):
        pick = order[lo : lo + BATCH]
        size = shard.offs[pick + 1] - shard.offs[pick]
        text = np.repeat(np.arange(len(pick)), size)
        at = shard.flat[np.arange(len(text)) + np.repeat(shard.offs[pick] - np.cumsum(size) + size, size)]
        sums = np.stack([np.bincount(text, v[at, f], len(pick)) for f in range(RANK)], axis=1)
        squares = np.bincount(text, (v[at] ** 2).sum(1), len(pick))
        s = b + np.bincount(text, w[at], len(pick)) + 0.5 * ((sums**2).sum(1) - squares)
        y = shard.y[pick]
        err = weights[y] * (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y) / len(pick)
        grad = np.bincount(at, err[text], n) + l2 * w
        gw += grad**2
        w -= rate * grad / np.sqrt(gw)
        for f in range(RANK):
            grad = np.bincount(at, err[text] * (sums[text, f] - v[at, f]), n) + l2 * v[:, f]
            gv[:, f] += grad**2
            v[:, f] -= 0.3 * rate * grad / np.sqrt(gv[:, f])
        g = float(err.sum())
        gb += g * g
        b -= 0.3 * rate * g / gb**0.5
    after = state.copy()
    after[:n] = np.column_stack([w, v, gw, gv])
    after[n, 0], after[n, 1 + RANK] = b, gb
    return after


def fit(rows: list[tuple[int, np.ndarray]], totals: tuple[int, int], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> Machine:
    """Train on (label, buckets) rows in memory, as ``train`` does on one shard; ``totals``: how many clean and toxic labels there are in all, for the weights of the two."""
    y = np.array([r[0] for r in rows], dtype=np.int64)
    n = (int((y == 0).sum()), int(y.sum()))
    none = np.empty(0, np.int64)
    if not all(n):
        return _machine(none, _start(0, totals))
    shard = Shard(y, np.concatenate([b for _, b in rows]).astype(np.int64), np.concatenate([[0], np.cumsum([len(b) for _, b in rows])]))
    # Buckets of a row are distinct.
    seen = np.stack([np.bincount(shard.flat[np.repeat(y == k, np.diff(shard.offs))], minlength=SIZE) for k in (0, 1)]).astype(np.float64)
    buckets, some, alone = telling_terms(seen, n)
    if len(some):
        buckets = np.union1d(buckets, some[telling_pairs(joint_counts(shard.placed(some), len(some)), 0, alone, n)])
    state, own = _start(len(buckets), totals), shard.placed(buckets)
    for k in range(epochs):
        state = epoch(state, own, _weights(n, totals), (k, 0), rate, l2)
    return _machine(buckets, state)


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, text) to learn from: every labelled text, but of near copies with one label, and of rows that share a doc_id, the first for all."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in tk.slices(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("hash")[i:j], pa.array(least_passages(buf, offs))], ["doc_id", "hash", "key"])

    # Texts are read where they lie for this: only ids and hashes meet the labels.
    hashed = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    keys = hashed.mapInArrow(tk.lean(passages), "doc_id long, hash long, key long").groupBy("doc_id").agg(F.min(F.struct("key", "hash")).alias("x"))
    rows = keys.join(labels.hint("merge"), "doc_id").select("doc_id", "label", "x.key", "x.hash")
    alone = F.when(F.col("key") == -1, F.col("doc_id")).alias("alone")  # texts without a passage are no copies
    first = rows.groupBy("label", "key", alone).agg(F.min(F.struct("doc_id", "hash")).alias("x")).select("x.doc_id", "x.hash", "label")
    return hashed.join(first.hint("merge"), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "label", "text")


def count_terms(texts: DataFrame) -> DataFrame:
    """(bucket, clean, toxic): how many texts of each label have a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SIZE), np.int64)
        for b in batches:
            label = np.asarray(b.column("label"))
            for i, j, buf, offs in tk.slices(b.column("text")):
                text, bucket = terms(buf, offs)
                own = label[i:j][text]
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[own == k], minlength=SIZE)
        # A row for each bucket and task at most: summed before the shuffle, whatever the input.
        full = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(seen[0, full]), pa.array(seen[1, full])], ["bucket", "clean", "toxic"])

    return texts.mapInArrow(tk.lean(run), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def shards_of(texts: DataFrame, buckets: np.ndarray, n: int) -> DataFrame:
    """The training rows with their terms among ``buckets``, dealt over ``n`` shards by the hash of doc_id; a shard is one row."""
    chosen = np.zeros(SIZE, bool)
    chosen[buckets] = True
    shared = texts.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in tk.slices(b.column("text")):
                text, bucket = terms(buf, offs, shared.value)
                cuts = np.searchsorted(text, np.arange(j - i + 1))
                own = [bucket[x:y].astype(np.uint32).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(c)[i:j] for c in ("shard", "doc_id", "label")] + [pa.array(own, pa.binary())], ["shard", "doc_id", "label", "terms"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        own = [x.as_buffer() for x in rows.column("terms")]
        labels = np.asarray(rows.column("label")).astype(np.int8).tobytes()
        sizes = np.array([len(x) // 4 for x in own], np.uint32).tobytes()
        return pa.table({"shard": rows.column("shard")[:1], "labels": [labels], "sizes": [sizes], "terms": [b"".join(own)]})

    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).mapInArrow(tk.lean(run), "shard int, doc_id long, label int, terms binary")
    return dealt.groupBy("shard").applyInArrow(pack, "shard int, labels binary, sizes binary, terms binary")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    for b in batches:
        for k in range(b.num_rows):
            y, size, flat = (np.frombuffer(b.column(c)[k].as_buffer(), t).astype(np.int64) for c, t in (("labels", np.int8), ("sizes", np.uint32), ("terms", np.uint32)))
            yield b.column("shard")[k].as_py(), Shard(y, flat, np.concatenate([[0], np.cumsum(size)]))


def pairs_of_shards(shards: DataFrame, some: np.ndarray, alone: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """The buckets of ``some`` that ``telling_pairs`` finds by the joint counts of all shards, which are summed part by part of the matrix."""
    width = len(some)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, width, width), np.int32)
        for _, shard in _read_shards(batches):
            joint_counts(shard.placed(some), width, both)
        for lo in range(0, width if both.any() else 0, PART):
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([both[:, lo : lo + PART, lo:].tobytes()])], ["part", "counts"])

    def decide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lo = 0, 0
        for b in parts:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                lo, total = part, total + np.frombuffer(counts.as_buffer(), np.int32).reshape(2, -1, width - part).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(telling_pairs(total, lo, alone, rows))], ["place"])

    found = shards.mapInArrow(tk.lean(count), "part int, counts binary").groupBy("part").applyInArrow(decide, "place long").distinct().toArrow()
    return np.sort(some[found.column("place").to_numpy()])


def train(docs: DataFrame, labels: DataFrame, shard_terms: int = SHARD_TERMS) -> Machine:
    """Train on every labelled text, held-out rows left out.

    Of rows that share a doc_id, and of near copies with one label (those with the same least hash
    of their five-word passages), the first counts for all: copies would only weigh a text more.
    A doc_id with several labels counts as toxic if any of them does.

    Terms are selected by counts over all rows.  The rows are dealt over shards; in each epoch every
    shard goes on from the common machine with its own rows, and the average of the results, by
    rows, is the next common machine.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    by_label = lambda df: tuple(dict(df.groupBy("label").count().collect()).get(k, 0) for k in (0, 1))
    totals = by_label(usable)
    texts = work.keep(training_texts(docs, usable), "texts")
    rows = by_label(texts)
    if not all(rows):
        work.drop_all_but()
        return _machine(np.empty(0, np.int64), _start(0, totals))
    found = work.keep(count_terms(texts), "terms").toArrow()
    seen = np.zeros((2, SIZE))
    for k, label in enumerate(("clean", "toxic")):
        seen[k, found.column("bucket").to_numpy()] = found.column(label).to_numpy()
    buckets, some, alone = telling_terms(seen, rows)
    either = np.union1d(buckets, some)
    n = 1 + int(seen[:, either].sum()) // shard_terms
    shards = work.keep(shards_of(texts, either, n), "shards")
    work.drop_all_but(shards)
    if len(some):
        buckets = np.union1d(buckets, pairs_of_shards(shards, some, alone, rows))
    state = _train_shards(shards, n, buckets, _start(len(buckets), totals), rows, _weights(rows, totals))
    work.drop_all_but()
    return _machine(buckets, state)


def _train_shards(shards: DataFrame, n: int, buckets: np.ndarray, state: np.ndarray, rows: tuple[int, int], weights: np.ndarray) -> np.ndarray:
    columns = [f"c{k}" for k in range(state.shape[1])]
    together = EPOCHS if n == 1 else 1  # a single shard has none to meet

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, at = shared.value
        for k, shard in _read_shards(batches):
            own, after = shard.placed(buckets), common
            for more in range(together):
                after = epoch(after, own, weights, (at + more, k))
            part = np.rint(after * (len(own.y) / sum(rows) / UNIT)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), *map(pa.array, np.ascontiguousarray(part.T))], ["place", *columns])

    for at in range(0, EPOCHS, together):
        shared = shards.sparkSession.sparkContext.broadcast((state, at))
        out = shards.mapInArrow(tk.lean(learn), "place long, " + ", ".join(f"{c} long" for c in columns)).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        state = np.empty_like(state)
        for k, c in enumerate(columns):
            state[out.column("place").to_numpy(), k] = out.column(c).to_numpy() * UNIT
        shared.destroy()
    return state


def _scorer(m: Machine) -> Callable[[pa.Array], np.ndarray]:
    """A function from texts to scores."""
    chosen = np.zeros(SIZE, bool)
    chosen[m.buckets] = True

    def score(texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j, buf, offs in tk.slices(texts):
            text, bucket = terms(buf, offs, chosen)
            out[i:j] = m.scores(text, bucket, j - i)
        return out

    return score


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from THRESHOLD on), from the whole text alone.

    Cases: a null or empty text has no term and gets the score of the bias; repeated rows score
    alike; all columns of ``docs`` stay (its own score or predicted columns are replaced); an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in batches:
            scores = score(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(tk.lean(run), schema)


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that ``machine`` doesn't predict to be toxic, with all their columns as they are; cases as in ``score_toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in batches:
            for i, j, _, _ in tk.slices(b.column("text")):  # what goes back is never a second whole batch
                part = b[i:j]
                yield part.filter(pa.array(score(part.column("text")) < THRESHOLD))

    return docs.mapInArrow(tk.lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
