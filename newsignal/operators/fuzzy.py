"""Groups of similar names: every pair from a ratio on, then a pass that lets earlier names lead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import greedy_losers
from .store import Scratch


def sorted_words(name: Column) -> Column:
    """Lower-case words in order, one blank between them."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")), " ")


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence against both lengths; of two empty texts 100."""
    if a == b:
        return 100.0
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    best = np.zeros(len(y) + 1, np.int64)
    for c in x:
        # What ends with this letter, or the best so far without it.
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (y == c)))
    return 200.0 * float(best[-1]) / (len(x) + len(y))


def letter_bits(s: str) -> int:
    """64 bits of a text: whether letters of each of 32 kinds stand in it, once and twice.

    A letter that is left out or put in changes one bit at most.
    """
    once = twice = 0
    for c in s:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    return once | (twice << 32)


def text_pairs(texts: DataFrame, least: float, work: Scratch) -> DataFrame:
    """(x, y) of distinct texts x < y (column s) that may reach a ratio of ``least``; no pair that does is missing.

    With a ratio of r hundredths at most (1 - r) of both lengths are left out or put in, and each
    such letter takes two pairs of neighbouring letters of a text at most.  So two similar texts
    share one of the first pairs of each, the rarest first; their lengths tell how many these are.
    Of texts that meet so, those count whose ``letter_bits`` differ by no more than that many letters.
    """
    r = least / 100
    edits = F.floor(F.col("n") * (1 - r) * 2 / r + 1e-9)  # the other text has at most (2 / r - 1) times the letters
    padded = F.concat(F.lit("\u0002"), "s", F.lit("\u0003"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.append_column("bits", pa.array(np.array([letter_bits(s) for s in part.column("s").to_pylist()], np.uint64).view(np.int64)))

    marked = texts.select("s").filter("s <> ''").mapInArrow(bits, "s string, bits long")
    grams = marked.select("s", F.length("s").alias("n"), "bits", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("at", "g"))
    same = Window.partitionBy("s", "g").orderBy("at")  # one text
    numbered = work.keep(grams.withColumn("k", F.row_number().over(same)).select("s", "n", "bits", "g", "k"))
    often = numbered.groupBy("g", "k").agg(F.count("*").alias("df"))
    order = Window.partitionBy("s").orderBy("df", "g", "k")  # one text
    first = numbered.join(often, ["g", "k"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * edits + 1).filter("df > 1")
    first = work.keep(first.select("s", "n", "bits", "g", "k"))
    a, b = (first.select("g", "k", F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}")) for c in "xy")
    both = F.col("nx") + F.col("ny")
    near = (F.least("nx", "ny") * 2 >= r * both - 1e-9) & (F.bit_count(F.col("bits_x").bitwiseXOR(F.col("bits_y"))) <= (1 - r) * both + 1e-9)
    return a.join(b, ["g", "k"]).filter(near & (F.col("x") < F.col("y"))).select("x", "y").distinct()


def similar_texts(texts: DataFrame, least: float, work: Scratch) -> DataFrame:
    """(x, y, ratio) of all distinct texts x < y (column s) whose ratio reaches ``least``, exactly."""
    pairs = text_pairs(texts, least, work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = part.column("x").to_pylist(), part.column("y").to_pylist()
            found = np.array([ratio(s, t) for s, t in zip(x, y, strict=True)])
            good = pa.array(found >= least)
            yield pa.RecordBatch.from_arrays([part.column("x").filter(good), part.column("y").filter(good), pa.array(found[found >= least])], ["x", "y", "ratio"])

    return work.keep(pairs.mapInArrow(run, "x string, y string, ratio double"))


def leader_groups(names: DataFrame, name: str, order: str, least: float = 85.0) -> DataFrame:
    """(name, canonical): in ascending order (then by name) each name joins the most similar leading name before it, from ``least`` on, or leads itself.

    All pairs of names count, whatever their first letters.  Of equally similar leaders the earliest
    counts.  Null names are left out, and of a repeated name the earliest row counts.
    """
    work = Scratch(names.sparkSession)
    rows = names.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(order).alias("at"))
    rows = work.keep(rows.withColumn("s", sorted_words(F.col("name"))))
    texts = similar_texts(rows.select("s").distinct(), least, work)
    both = texts.unionByName(texts.select(F.col("y").alias("x"), F.col("x").alias("y"), "ratio")).unionByName(rows.select(F.col("s").alias("x"), F.col("s").alias("y"), F.lit(100.0).alias("ratio")).distinct())
    early, late = rows.select(F.col("s").alias("x"), F.struct("at", "name").alias("a")), rows.select(F.col("s").alias("y"), F.struct("at", "name").alias("b"))
    pairs = work.keep(both.join(early, "x").join(late, "y").filter("a < b").select("a", "b", "ratio"))
    followers = greedy_losers(pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b")), work)
    leads = pairs.join(followers.select(F.col("id").alias("_name")), F.col("a.name") == F.col("_name"), "left_anti")
    best = leads.groupBy(F.col("b.name").alias("name")).agg(F.min(F.struct((-F.col("ratio")).alias("minus"), "a")).alias("best")).select("name", F.col("best.a.name").alias("canonical"))
    out = work.keep(rows.select("name").join(best, "name", "left").select(F.col("name").alias(name), F.coalesce("canonical", "name").alias("canonical")))
    work.drop_all_but(out)
    return out
