"""Fill-in-the-middle transformation of texts, cut between lines, by DuckDB SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table

#: Seed of the draws, hundredths of texts that are transformed, and hundredths of those in suffix-prefix-middle order.
SEED, RATE, SPM = 7, 100, 50
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that one statement works on, or one longer text.
SLICE = 4 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _statement(seed: int, rate: int, spm: int) -> str:
    """SQL over the registered batch: units, draws by hash, the cut, the form, the output."""
    draw = lambda k: f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS UBIGINT)"
    part = lambda low, high: f"array_to_string(list_slice(units, {low}, {high}), '')"
    return f"""
WITH cut AS (
  SELECT doc_id, place, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM batch),
drawn AS (SELECT *, len(units) AS n, {draw(0)} % (len(units) + 1) AS x, {draw(1)} % (len(units) + 1) AS y, {draw(2)} % 100 AS chance, {draw(3)} % 100 AS turn FROM cut),
formed AS (
  SELECT *, least(x, y) AS low, greatest(x, y) AS high,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR chance >= {rate} THEN 'plain' WHEN turn < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, {part('1', 'low')} AS prefix, {part('low + 1', 'high')} AS middle, {part('high + 1', 'n')} AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts ORDER BY place"""


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    A text is cut into n lines (with their line breaks), and at two of the n + 1 places between
    them, drawn by the SHA-256 of seed and doc_id, into prefix, middle and suffix.  ``form``:
    ``psm`` or ``spm`` by the order of the parts in ``output``, or ``plain`` for the text as it is.

    Cases: a null text is an empty one, and an empty text is plain; so is one that holds a mark,
    which could not be told from the marks put in; a very long text is one statement's work alone;
    rows that share a doc_id draw alike; a null doc_id draws as an empty one and stays null; equal
    draws give an empty middle; extra columns are ignored; no documents give no rows.
    """
    sql = _statement(seed, rate, spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # One statement at a time on one core, as Spark runs one task on each.
        with duckdb.connect(":memory:", config={"threads": 1}) as con:
            for b in batches:
                for i, j, _, _ in tk.slices(b.column("text"), SLICE):
                    place = pa.array(range(j - i), pa.int64())
                    con.register("batch", pa.table({"doc_id": b.column("doc_id")[i:j], "text": b.column("text")[i:j], "place": place}))
                    out = con.execute(sql).to_arrow_table()
                    con.unregister("batch")
                    yield from out.to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made an output of; a text with a mark is plain, so each mark stands in an output once."""
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    after = F.substr(output, F.length(first) + 1)
    one = F.split_part(after, second, F.lit(1))
    rest = F.split_part(after, second, F.lit(2))
    two, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: By places of line breaks instead of lists of lines.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS n,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, string_split(text, chr(10)) AS lines,
        text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 AS plain FROM u),
w AS (SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(lines[1:a], chr(10)) || chr(10) END AS prefix,
        CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(lines[1:b], chr(10)) || chr(10) END AS front FROM v),
x AS (SELECT doc_id, n, plain, text, h4 % 100 < 50 AS spm, prefix, substr(front, length(prefix) + 1) AS middle, substr(text, length(front) + 1) AS suffix FROM w),
y AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM y
"""
