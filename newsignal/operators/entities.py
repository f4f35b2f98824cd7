"""Names in texts: all occurrences of a list of names, by an automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the names of one automaton, which every task holds; a longer list is searched in parts of this size.
LETTERS = 4 << 20
#: Texts whose findings a task writes at a time.
CHUNK = 128


def find_names(docs: DataFrame, names: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, name, n, first) of every name that a text holds, letter by letter: how often, without overlaps of itself, and where first (from 1).

    ``names``: name.  An Aho-Corasick automaton reads each text once, however many names there are.
    Automata are bounded: a list of more than LETTERS letters is dealt into several, each of which
    reads all texts.

    Cases: null and empty texts and names are found nowhere; names inside other names count too;
    a name that is listed twice counts once; rows are searched each on its own.
    """
    rows = docs.select(F.col(key).alias("key"), text.alias("text")).filter("text is not null")
    listed = names.select("name").filter("name <> ''").distinct()
    letters = listed.agg(F.sum(F.length("name")).alias("x")).first()["x"] or 0
    parts = max(1, -(-letters // LETTERS))
    kind = docs.schema[key].dataType.simpleString()
    spark, out = docs.sparkSession, None
    for k in range(parts):
        own = [r["name"] for r in listed.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect()]
        held = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            words = held.value
            machine = ahocorasick.Automaton()
            for i, w in enumerate(words):
                machine.add_word(w, i)
            machine.make_automaton()
            for b in batches:
                for at in range(0, b.num_rows if words else 0, CHUNK):
                    part = b[at : at + CHUNK]
                    keys, which, times, first = [], [], [], []
                    for row, t in enumerate(part.column("text").to_pylist()):
                        found: dict[int, list[int]] = {}
                        for end, i in machine.iter(t):
                            start = end + 1 - len(words[i])
                            seen = found.get(i)
                            if seen is None:
                                found[i] = [1, start + 1, end + 1]
                            elif start >= seen[2]:
                                seen[0] += 1
                                seen[2] = end + 1
                        keys += [row] * len(found)
                        which += [words[i] for i in found]
                        times += [x[0] for x in found.values()]
                        first += [x[1] for x in found.values()]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(keys, pa.int32())), pa.array(which, pa.string()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], ["key", "name", "n", "first"])

        more = rows.mapInArrow(run, f"key {kind}, name string, n long, first long")
        out = more if out is None else out.unionByName(more)
    return out.withColumnRenamed("key", key)


def places(rows: DataFrame, text: str, names: str) -> DataFrame:
    """``rows`` once for each of their own ``names`` (an array): name, n, first as in ``find_names``, instead of text and names.

    A text is searched for its own names only, letter by letter where it lies.
    """
    others = [f for f in rows.schema.fields if f.name not in (text, names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b[at : at + CHUNK]
                which, found, times, first = [], [], [], []
                for row, (t, own) in enumerate(zip(part.column(text).to_pylist(), part.column(names).to_pylist(), strict=True)):
                    for w in own or () if t is not None else ():
                        if n := t.count(w):
                            which.append(row)
                            found.append(w)
                            times.append(n)
                            first.append(t.index(w) + 1)
                take = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).take(take) for f in others), pa.array(found, pa.string()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], [*(f.name for f in others), "name", "n", "first"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{schema}, name string, n long, first long")
