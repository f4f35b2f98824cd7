"""Language of texts by character trigrams, learnt from rows whose language is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams are counted in so many buckets; a model has one row for each language and bucket at most.
BUCKETS = 1 << 16
#: Languages of a model at most, which bounds what each task holds.
LANGUAGES = 256
#: Shorter texts pass every gate.
SHORT = 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def trigrams(text: str | None) -> np.ndarray:
    """The bucket of each three characters of a lower-cased text with a blank at both ends."""
    c = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = c[:-2] * _MULTIPLIERS[0] ^ c[1:-1] * _MULTIPLIERS[1] ^ c[2:] * _MULTIPLIERS[2]
    return ((h ^ h >> np.uint32(15)) % np.uint32(BUCKETS)).astype(np.int64)


def learn(docs: DataFrame, text: str, language: str) -> DataFrame:
    """(language, bucket, n): trigrams of all texts of each language; rows without one teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages = b.column("language").to_pylist()
            for name in sorted(set(languages)):
                counts = np.zeros(BUCKETS, np.int64)
                for k, other in enumerate(languages):
                    if other == name:
                        t = trigrams(b.column("text")[k].as_py())
                        counts += np.bincount(t, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["language", "bucket", "n"])

    rows = docs.select(F.col(language).alias("language"), F.col(text).alias("text")).filter("language is not null and text is not null")
    return rows.mapInArrow(run, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def weights(model: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray]:
    """Names, and the logarithm of each bucket's share in each language, every bucket counted once more."""
    names = sorted({m[0] for m in model})
    counts = np.ones((BUCKETS, len(names)))
    for name, bucket, n in model:
        counts[bucket, names.index(name)] += n
    return names, np.log(counts / counts.sum(0))


def identify(docs: DataFrame, text: str, model: DataFrame) -> DataFrame:
    """``docs`` with predicted: the language whose trigrams make the text likeliest; the first by name of equals, null for texts without characters or a model without rows."""
    spark = docs.sparkSession
    if model.select("language").distinct().count() > LANGUAGES:
        raise ValueError(f"a model of more than {LANGUAGES} languages")
    names, logs = weights([tuple(r) for r in model.select("language", "bucket", "n").collect()])  # LANGUAGES times BUCKETS rows at most
    held = spark.sparkContext.broadcast((names, logs))

    @F.pandas_udf("string")
    def likeliest(texts):
        import pandas as pd

        names, logs = held.value
        out = []
        for t in texts:
            b = trigrams(t) if t else ()
            out.append(names[int(logs[b].sum(0).argmax())] if len(b) and names else None)
        return pd.Series(out, dtype=object)

    return docs.withColumn("predicted", likeliest(F.col(text)))


def language_gate(docs: DataFrame, text: str, allowed: list[str], model: DataFrame) -> DataFrame:
    """``docs`` with predicted and passes: texts of an allowed language, of fewer than SHORT characters, or of no known one."""
    short = F.length(F.coalesce(text, F.lit(""))) < SHORT
    return identify(docs, text, model).withColumn("passes", short | F.coalesce(F.col("predicted").isin(allowed), F.lit(True)))
