"""Periodic runs of words: every document is compared with itself shifted by every lag."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import WORD, table

#: A run repeats its period so often at least, and has so many words at least.
MIN_EXPONENT, MIN_LENGTH = 2, 12
#: Comparisons of words that one range of lags may cost; a document with more is dealt out in several ranges.
RANGE_COST = 1 << 27
#: Comparisons that are held at a time.
BLOCK = 1 << 18

RUNS = "array<struct<start:long,length:long,period:long>>"
_NONE = np.empty((0, 3), np.int64)


def scan(ids: np.ndarray, low: int, high: int, least: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of all maximal repeats with a period from low up to before high, in any order.

    A row of the block is the array compared with itself shifted by one lag.  A run of period q has
    max(q, least - q) equal words on end, and so half of ``least`` at least: stretches of so many are
    found by doubling (equal for 1, 2, 4, ... words) and then run-length coded.
    """
    n, short = len(ids), max(1, least // 2)
    high = min(high, n // MIN_EXPONENT + 1)
    if n < least or low >= high:
        return _NONE
    found = []
    while low < high:
        wide = n - low
        rows = min(high - low, max(1, BLOCK // wide))
        padded = np.concatenate([ids, np.full(rows, -1, ids.dtype)])
        shifted = np.lib.stride_tricks.sliding_window_view(padded[low:], wide)[:rows]
        # One column more, always different, so that no stretch goes on into the next row.
        equal = np.zeros((rows, wide + 1), bool)
        np.equal(shifted, ids[:wide], out=equal[:, :wide])
        flat, have = equal.reshape(-1), 1
        while have < short:
            step = min(have, short - have)
            flat = flat[:-step] & flat[step:]
            have += step
        at = np.flatnonzero(flat)
        if len(at):
            heads = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            start = at[heads]
            size = np.diff(np.append(heads, len(at))) + short - 1
            row, start = np.divmod(start, wide + 1)
            period = row + low
            long_ = (size >= (MIN_EXPONENT - 1) * period) & (size + period >= least)
            found.append(np.stack([start, size + period, period], 1)[long_])
        low += rows
    return np.concatenate(found) if found else _NONE


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """One row for each stretch, with its smallest period, by start and period.

    A stretch that also has a smaller period has one that divides the larger one, and then both
    are maximal over the same words.
    """
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """True for each of n words that some run has after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each text its words with one space between; counts: words of each text."""
    sizes = ends - starts + 1
    to = np.cumsum(sizes)
    source = np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)
    out = np.append(buf, np.uint8(32))[np.minimum(source, len(buf))]
    out[to - 1] = 32
    cuts = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])]
    full = counts > 0
    # Texts lie one after the other without the space at each one's end.
    keep = np.ones(len(out), bool)
    keep[cuts[1:][full] - 1] = False
    offs = cuts - np.concatenate([[0], np.cumsum(full)])
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out[keep])])


def _runs_array(found: list[np.ndarray]) -> pa.Array:
    every = np.concatenate(found) if found else _NONE
    rows = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32()), rows)


def _parsed(texts: pa.Array) -> Iterator[tuple]:
    """(first, last, bytes, starts, ends, first words, word ids) of slices of texts."""
    for i, j, buf, offs in tk.slices(texts):
        starts, ends, first = tk.word_spans(buf, offs)
        _, ids = np.unique(tk.span_hashes(buf, starts, ends), return_inverse=True)
        yield i, j, buf, starts, ends, first, ids.astype(np.int32)


def _collapsed(b: pa.RecordBatch, keys: list[str], runs_of) -> Iterator[pa.RecordBatch]:
    """keys, n_words, runs and collapsed text of each row; runs_of: from a row and its ids to its runs."""
    for i, j, buf, starts, ends, first, ids in _parsed(b.column("text")):
        found = [runs_of(i + t, ids[first[t] : first[t + 1]]) for t in range(j - i)]
        keep = np.ones(len(ids), bool)
        for t, r in enumerate(found):
            if len(r):
                keep[first[t] : first[t + 1]] = ~repeated(r, int(first[t + 1] - first[t]))
        total = np.concatenate([[0], np.cumsum(keep)])
        text = joined_words(buf, starts[keep], ends[keep], np.diff(total[first]))
        yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in keys), pa.array(np.diff(first)), _runs_array(found), text.cast(pa.string())], [*keys, "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = MIN_LENGTH, range_cost: int = RANGE_COST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row.

    A run is a stretch of ``least`` words or more with a smallest period that it holds twice at
    least, and that no neighbouring word extends.  ``collapsed``: the words that no run repeats,
    joined by one space.

    A document is compared with itself shifted by each lag up to half of its words, which costs the
    square of its length.  Documents of up to ``range_cost`` comparisons are done where they are
    read.  Longer ones are dealt over the cluster in ranges of lags of so many comparisons each;
    what the ranges find meets by document, start and length, and the smallest period stays.

    Cases: a null or empty text, or one without words, has no runs and an empty collapsed text; a
    very long text is dealt out as above; ties don't occur, as no two runs of a text share start
    and length; repeated rows, rows that share a doc_id, and null doc_ids each give a row of their own;
    extra columns are ignored; no documents give no rows.
    """
    docs = docs.select("doc_id", "text")
    words = F.col("n_words")
    cost = words * words / MIN_EXPONENT  # words by lags, at most
    # Words have one character and one separator at least: only texts that may be too long are counted.
    most = (F.octet_length("text") + 1) / 2
    few = most * most / MIN_EXPONENT <= range_cost
    counted = F.when(~few, F.regexp_count("text", F.lit(WORD))).otherwise(0)
    sized = docs.withColumn("n_words", F.coalesce(counted, F.lit(0)).cast("double"))
    parts = F.greatest(F.ceil(cost / range_cost), F.lit(1)).cast("int")
    short, long_ = sized.filter(parts == 1).select("doc_id", "text"), sized.filter(parts > 1).withColumn("parts", parts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _collapsed(b, ["doc_id"], lambda _, ids: smallest_periods(scan(ids, 1, len(ids), least)))

    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    done = short.mapInArrow(whole, schema)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, _, _, first, ids in _parsed(b.column("text")):
                for t in range(j - i):
                    own, part, parts = ids[first[t] : first[t + 1]], b.column("part")[i + t].as_py(), b.column("parts")[i + t].as_py()
                    lags = len(own) // MIN_EXPONENT + 1
                    r = smallest_periods(scan(own, 1 + part * lags // parts, 1 + (part + 1) * lags // parts, least))
                    yield pa.RecordBatch.from_arrays([pa.array([b.column("row")[i + t].as_py()] * len(r), pa.string()), *(pa.array(r[:, k]) for k in range(3))], ["row", "start", "length", "period"])

    # A text is known by its digest, so that rows which share a doc_id don't mix; equal texts are scanned once.
    texts = long_.select(F.sha2("text", 256).alias("row"), "text", "parts")
    once = texts.dropDuplicates(["row"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = once.repartition("row", "part").mapInArrow(ranges, "row string, start long, length long, period long")
    least_period = found.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    runs = least_period.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))  # of one text: fewer than its words
    rows = long_.select("doc_id", "text", F.sha2("text", 256).alias("row")).join(runs, "row", "left").select("doc_id", "text", F.col("found.start"), F.col("found.length"), F.col("found.period"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in ("start", "length", "period")]
            at = lambda k: np.array([c[k].as_py() or [] for c in columns], np.int64).reshape(3, -1).T
            yield from _collapsed(b, ["doc_id"], lambda k, _, at=at: at(k))

    return done.unionByName(rows.mapInArrow(collapse, schema))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where the texts of about a tenth, by the hash of their doc_id, go on periodically from some word on."""

    def plant(doc_id: int, text: str | None) -> str | None:
        h = zlib.crc32(str(doc_id).encode())
        words = re.findall(WORD, text or "") if h % 10 == 0 else []
        if not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(words[:a] + [words[a + k % p] for k in range(n - a)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            chosen = pa.array([x is not None and zlib.crc32(str(x).encode()) % 10 == 0 for x in ids.to_pylist()], pa.bool_())
            planted = [plant(x, t) for x, t in zip(ids.filter(chosen).to_pylist(), texts.filter(chosen).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pc.replace_with_mask(texts, chosen, pa.array(planted, texts.type))], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"), (-r["period"]).alias("minus_period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("_r", longest)
    length, period = F.col("_r.length"), -F.col("_r.minus_period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_r.minus_start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
