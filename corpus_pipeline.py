"""The text pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.llm import bpe, decontam, jaccard, quality, toxicity
from newsignal.llm.shared import WORD, Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts to be toxic go.

    Null and empty texts get the score of the bias, which is near the share of toxic labels, and so
    stay unless toxic labels abound; a very long text is scored whole;
    repeated rows stay or go together; a score just at the threshold is toxic; columns of any name
    are left as they are; no documents give none.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words, which the base rules reject; a very long text is rated
    whole; repeated rows stay or go together; a ratio just at the threshold is kept; columns of any
    name are left as they are; no documents give none.
    """
    return quality.drop_rejected(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id stays.

    Null, empty and wordless texts link with nothing and stay, as do rows without a doc_id; rows
    that share a doc_id are judged by their own texts, of which the one with the least hash goes
    first; of repeated rows and of rows that share doc_id and text, the one with the least hash of
    its columns stays (maps, which have none, are left out of it); a very long text is compared
    whole; columns of any name are left as they are; no documents give none.
    """
    first = jaccard.first_of_each(docs).withColumnsRenamed({"doc_id": "_first_id", "key": "_first_key"})
    linkable = F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(WORD)
    key = jaccard.text_key(F.col("text"))
    rows = docs.filter(linkable).join(first.hint("merge"), (F.col("doc_id") == F.col("_first_id")) & (key == F.col("_first_key")))
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    once = rows.groupBy("_first_id", "_first_key").agg(F.min_by(F.struct(*docs.columns), hashed).alias("_row")).select("_row.*")
    return once.unionByName(docs.filter(~linkable)).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a benchmark item go.

    Null and empty texts hold none and stay; a very long text is searched passage by passage;
    repeated rows stay or go together; overlaps just at the bounds count as leaks; columns of any
    name are left as they are; no documents give none, an empty benchmark takes none.
    """
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, and their digests: a row for each row.

    A null or empty text has no ids; a very long text is encoded whole; repeated rows are encoded
    alike; a null doc_id stays null; other columns are left out; no documents give no rows.
    """
    pieces, pairs = bpe.SMALL  # the stages before have filled the workers, and the next run uses them again
    return bpe.encode_texts(docs.select("doc_id", "text"), *bpe.public_vocabulary(), cache=pieces, pairs=pairs, forget=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

#: Trained models and similarity joins are beyond SQL; the tests compare the result with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's table goes when the next one has been written."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        work.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
