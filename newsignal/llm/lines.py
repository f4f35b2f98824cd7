"""Line deduplication across documents, with DataFrame functions only: bitmaps of what each document keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace, ascii_lower, table

#: Code points of a line's key, and documents that hold it, from which on a line is a repeated one.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: White space at both ends of a line that isn't part of its key.
BLANKS = " \t\n\x0b\x0c\r"
#: A key in more than a fraction 1 / HOT of all (line, document) pairs is a hot one, so there are fewer than HOT of them.
HOT = 1024


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def row_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """A bitmap as run lengths: lines kept, lines dropped, lines kept, and so on; ``dropped``: sorted line numbers."""
    heads = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    tails = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    # Where each stretch begins, kept and dropped ones in turn; the difference of neighbours is a length.
    cuts = F.concat(F.array(F.lit(0)), F.flatten(F.zip_with(heads, tails, lambda a, b: F.array(a, b + 1))), F.array(n_lines))
    return F.transform(F.slice(cuts, 2, F.size(cuts) - 1), lambda x, i: x - F.get(cuts, i))


def expanded(runs: Column) -> Column:
    """Whether each line is kept, from a bitmap's run lengths."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n.cast("int"))))


def first_places(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc_id, places) for each line key and document that holds it, in ranges of keys; places: row and line number of each of its lines.

    Keys are two 64-bit hashes.  Ranges end between documents as well as between keys, so that a
    key which a third of all documents hold is split, and within a range rows are sorted by key,
    document and position: a key's lines in a document follow each other.
    """
    lines = docs.select("doc_id", row_key(F.col("text")).alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "pos")


def dropped_places(work: Workspace, docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(doc_id, row, pos) of the lines that go."""
    places = work.keep(first_places(docs, least_chars), "lines")
    ranged = places.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "row", "pos")
    once = Window.partitionBy("h1", "h2", "doc_id").orderBy("row", "pos")
    stream = work.keep(ranged.withColumn("first", F.row_number().over(once) == 1), "ranges")
    work.drop(places)
    # A range gives one row for each key that it holds; a key over several ranges meets in few of them.
    counts = stream.filter("first").groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = work.keep(counts.filter(F.col("n_docs") >= least_docs), "shared")
    pairs = stream.filter("first").count()
    # Fewer than HOT keys by their definition, so this side is bounded; every other key holds less than a fraction 1 / HOT of the pairs.
    hot = F.broadcast(shared.filter(F.col("n") * HOT > pairs).select("h1", "h2", F.col("last").alias("hot")))
    cold = shared.filter(F.col("n") * HOT <= pairs).select("h1", "h2", "last")
    marked = stream.join(hot, ["h1", "h2"], "left")
    often = marked.filter("hot is not null").withColumn("last", F.col("hot"))
    seldom = marked.filter("hot is null").join(cold.hint("merge"), ["h1", "h2"])
    return often.unionByName(seldom, allowMissingColumns=True).filter("not doc_id <=> last").select("doc_id", "row", "pos")


def line_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, row, n_lines, n_dropped and keep of every document: which of its lines stay, as run lengths (``keep_runs``).

    A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of
    ``least_chars`` code points or more that ``least_docs`` documents or more hold lose all lines
    but those of the largest doc_id that holds them.  ``row`` is ``row_key`` of the text.

    Cases: a null or empty text is one empty line, which stays; a very long text has as many lines
    as it has, each with any length; rows that share a doc_id count as one document and each get
    a bitmap, repeated rows share one; rows without a doc_id don't count as documents and lose the
    lines that others lose; a key held by documents of one doc_id alone stays; extra columns are
    ignored; no documents give no rows.
    """
    work = Workspace(docs.sparkSession, "lines")
    docs = docs.select("doc_id", "text")
    gone = dropped_places(work, docs, least_chars, least_docs).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))  # of one document
    gone = work.keep(gone, "dropped")
    work.drop_all_but(gone)
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    rows = docs.select("doc_id", row_key(F.col("text")).alias("row"), n_lines.alias("n_lines")).distinct()
    both = rows.join(gone.withColumnsRenamed({"doc_id": "_doc", "row": "_row"}).hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return both.select("doc_id", "row", F.col("n_lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), keep_runs(F.col("n_lines"), dropped).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of every row of ``docs`` after ``bitmaps`` (of ``line_bitmaps`` over the same rows)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key(F.col("text")).alias("row"))
    maps = bitmaps.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    # Both sides grow with the corpus.
    both = rows.join(maps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
    keep = expanded(F.col("keep"))
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), keep.alias("keep")), lambda x: x["keep"]), lambda x: x["line"]), "\n")
    return both.select("doc_id", "n_lines", "n_dropped", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept).alias("text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NULL OR k.doc_id IS NOT DISTINCT FROM s.last AS keep FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
