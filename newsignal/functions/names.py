"""Model answers: repair and reading as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired_json(text: Column) -> Column:
    """The outermost object of a model's answer: what stands around it is dropped, and what is open at the end is closed in order.

    Brackets inside strings count for nothing.
    """
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)([{].*)", 1), "(?s)`{3}\\s*$", "")
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        outside = ~a["quoted"]
        closes = outside & c.isin("}", "]")
        stack = F.when(outside & (c == "{"), F.concat(F.lit("}"), a["open"])).when(outside & (c == "["), F.concat(F.lit("]"), a["open"])).when(closes, F.substr(a["open"], F.lit(2))).otherwise(a["open"])
        quoted = F.when(a["quoted"] & a["escaped"], True).otherwise(F.when(c == '"', outside).otherwise(a["quoted"]))
        escaped = a["quoted"] & ~a["escaped"] & (c == "\\")
        end = F.when(closes & (stack == ""), a["at"] + 1).otherwise(0)
        now = F.struct(stack.alias("open"), quoted.alias("quoted"), escaped.alias("escaped"), (a["at"] + 1).alias("at"), end.alias("end"))
        return F.when(a["end"] > 0, a).otherwise(now)

    read = F.aggregate(F.split(body, ""), start, step)
    cut = F.when(read["quoted"], F.concat(body, F.lit('"'))).otherwise(F.regexp_replace(body, r"(?s)[,\s]+$", ""))
    return F.when(read["end"] > 0, F.left(body, read["end"])).otherwise(F.concat(cut, read["open"]))


def answer(text: Column, schema: str) -> Column:
    """A model's answer as a struct; fields that can't be read are null."""
    return F.from_json(repaired_json(text), schema)
