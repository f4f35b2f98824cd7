"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max WAND."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import Workspace, table

#: Passages are windows of so many words, one half apart; items are indexed in segments that fit in the overlap.
PASSAGE, SEGMENT = 128, 64
#: BM25 parameters; scores are shares of the score that an item has for itself.
K1, B = 1.2, 0.75
#: Share of its own score from which an item is retrieved.
RETRIEVED = 0.6
#: Shares of the question's and the answer's word trigrams that the document must contain.
QUESTION, ANSWER, GRAM = 0.7, 0.7, 3
#: Neighbouring segments of one block.
BLOCK = 4
#: Bytes of item texts in one index; more items are searched index by index, so that what is broadcast stays bounded.
INDEX_BYTES = 8 << 20

_WORD = np.zeros(256, dtype=bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD[ord(_a) : ord(_b) + 1] = True
_WORD[0x80:] = True


def fold(buf: np.ndarray) -> np.ndarray:
    """A copy with the accented capitals of Latin-1 in lower case (A-Z are folded by the hash)."""
    out = buf.copy()
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) else np.empty(0, np.int64)
    capital = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    out[capital] += 0x20
    return out


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of the first word of each text)."""
    buf = fold(buf)
    starts, ends, first = tk.word_spans(buf, offs, _WORD)
    return tk.span_hashes(buf, starts, ends, tk.FOLDED), first


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last line is the answer, else the last sentence, else the last quarter of the words; one word is all question."""
    text = text.strip()
    for mark in ("\n", ". ", "? ", "! "):
        head, _, tail = text.rpartition(mark)
        if head.strip() and tail.strip():
            return head + mark.strip(), tail
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return (" ".join(words[:cut]), " ".join(words[cut:])) if cut > 0 else (text, "")


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(tk.windows(words, np.array([0, len(words)]), n)[0])


@dataclass
class Postings:
    """One term's list: segments ascending, their impacts, and the last segment and largest impact of each block that it touches."""

    segments: list[int]
    impacts: list[float]
    block_last: list[int]
    block_max: list[float]
    top: float


@dataclass
class Index:
    """Segments of items with normalised impacts.

    ``common`` terms have the longest lists; together they never give a segment more than half of
    the threshold.  So a passage can only reach it in a block for which its other terms' block
    maxima sum up to the rest; passages without such a block are left out before the search.
    """

    items: list[int]
    terms: np.ndarray
    lists: list[Postings]
    common: np.ndarray
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = field(default_factory=dict)

    def rare_blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each term, block numbers, block maxima) of the lists that aren't common."""
        lists = [[] if c else list(zip(p.block_last, p.block_max, strict=True)) for c, p in zip(self.common, self.lists, strict=True)]
        flat = [x for one in lists for x in one]
        return np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]), np.array([x // BLOCK for x, _ in flat], np.int64), np.array([m for _, m in flat], np.float64)


def item_segments(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in equal segments that fit in the overlap of passages."""
    cuts = -(-len(words) // SEGMENT)
    return [words[len(words) * k // cuts : len(words) * (k + 1) // cuts] for k in range(cuts)]


@dataclass
class Statistics:
    """Of all items: segments, their mean length, and how many of them have each of some terms."""

    total: int
    mean: float
    df: dict[int, int]


def count_terms(texts: Iterable[str]) -> tuple[int, int, Counter[int]]:
    """(segments, words, segments of each term) of some items."""
    total, size, df = 0, 0, Counter()
    for text in texts:
        for words in item_segments(_hashes(text)):
            total, size = total + 1, size + len(words)
            df.update(np.unique(words).tolist())
    return total, size, df


def build_index(rows: list[tuple[int, str]], known: Statistics | None = None) -> Index:
    """Index (item_id, text) rows under the statistics of all items (of these rows if none are given).

    An item without words is never found, repeated ids are searched with all their texts.
    """
    if known is None:
        total, size, df = count_terms(text for _, text in rows)
        known = Statistics(total, size / max(1, total), df)
    segments: list[tuple[int, np.ndarray]] = []
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
    for item, text in rows:
        words = _hashes(text)
        if not len(words):
            continue
        question, answer = (_hashes(t) for t in split_item(text))
        n = min(GRAM, max(1, len(question)))
        parts.setdefault(item, []).append((_grams(question, n), answer, n))
        segments += [(item, part) for part in item_segments(words)]
    found: dict[int, list[tuple[int, int]]] = {}
    for number, (_, words) in enumerate(segments):
        for term, count in zip(*np.unique(words, return_counts=True), strict=True):
            found.setdefault(int(term), []).append((number, int(count)))
    total = len(segments)
    terms = sorted(found)
    impact: dict[int, list[float]] = {}
    own = np.zeros(total)
    for term in terms:
        df = known.df[term]
        idf = math.log(1 + (known.total - df + 0.5) / (df + 0.5))
        impact[term] = [idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(segments[s][1]) / known.mean)) for s, tf in found[term]]
        for (s, _), x in zip(found[term], impact[term], strict=True):
            own[s] += x
    lists = []
    for term in terms:
        at = [s for s, _ in found[term]]
        imp = [x / own[s] for s, x in zip(at, impact[term], strict=True)]
        tops: dict[int, float] = {}
        for x, y in zip(at, imp, strict=True):
            tops[x // BLOCK] = max(tops.get(x // BLOCK, 0.0), y)
        lists.append(Postings(at, imp, [(b + 1) * BLOCK - 1 for b in tops], list(tops.values()), max(imp)))
    common = np.zeros(len(terms), bool)
    share = np.zeros(total)
    for k in sorted(range(len(terms)), key=lambda k: (-len(lists[k].segments), terms[k])):
        p = lists[k]
        if len(p.segments) < 2:
            break
        if max(share[s] + x for s, x in zip(p.segments, p.impacts, strict=True)) <= RETRIEVED / 2:
            common[k] = True
            for s, x in zip(p.segments, p.impacts, strict=True):
                share[s] += x
    return Index([i for i, _ in segments], np.array(terms, np.uint64), lists, common, parts)


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """(segment, score) of all segments that reach the threshold for the terms (numbers, distinct) of a passage."""
    end = len(index.items)
    cursors = [[index.lists[t].segments[0], 0, 0, index.lists[t]] for t in query]  # segment, position, block, list
    out: list[tuple[int, float]] = []
    slack = threshold - 1e-9
    cursors.sort(key=lambda c: c[0])
    while cursors:
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c[3].top
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        at = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
            pivot += 1
        shallow, border = 0.0, end
        for c in cursors[: pivot + 1]:
            last, b = c[3].block_last, c[2]
            while b < len(last) and last[b] < at:
                b += 1
            c[2] = b
            if b < len(last):
                first = last[b] - BLOCK + 1
                shallow += c[3].block_max[b] if first <= at else 0.0
                border = min(border, last[b] + 1 if first <= at else first)
        if pivot + 1 < len(cursors):
            border = min(border, cursors[pivot + 1][0])
        if shallow >= slack:
            score = 0.0
            for c in cursors[: pivot + 1]:
                p = c[3]
                i = c[1]
                while i < len(p.segments) and p.segments[i] < at:
                    i += 1
                if i < len(p.segments) and p.segments[i] == at:
                    score += p.impacts[i]
                    i += 1
                c[1] = i
            if score >= slack:
                out.append((at, score))
        else:  # no segment before the border can reach the threshold
            target = max(border, at + 1)
            for c in cursors[: pivot + 1]:
                p, i = c[3], c[1]
                while i < len(p.segments) and p.segments[i] < target:
                    i += 1
                c[1] = i
        alive = []
        for c in cursors:
            if c[1] < len(c[3].segments):
                c[0] = c[3].segments[c[1]]
                alive.append(c)
        cursors = sorted(alive, key=lambda c: c[0])
    return out


class Searcher:
    """Searches all passages of a slice of texts."""

    def __init__(self, index: Index, threshold: float = RETRIEVED):
        self.index, self.threshold = index, threshold
        self.first, self.blocks, self.maxima = index.rare_blocks()
        self.rest = threshold - RETRIEVED / 2
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(index.terms >> np.uint64(48)).astype(np.int64)] = True

    def search(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of each retrieved item, once for a text."""
        index = self.index
        hashes, first = words_of(buf, offs)
        if not len(index.terms) or not len(hashes):
            return
        hit = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(index.terms, hashes[hit]), len(index.terms) - 1)
        ok = index.terms[place] == hashes[hit]
        term = np.full(len(hashes), -1)
        term[hit[ok]] = place[ok]
        sizes = np.diff(first)
        begin, stop, text, able = self._passages(term, first, sizes)
        best: dict[tuple[int, int], float] = {}
        for k in able:
            own = np.unique(term[begin[k] : stop[k]])
            for segment, score in block_max_wand(index, own[own >= 0].tolist(), self.threshold):
                key = int(text[k]), index.items[segment]
                best[key] = max(best.get(key, 0.0), score)
        for (t, item), score in sorted(best.items()):
            words = hashes[first[t] : first[t + 1]]
            q, a = max((self._overlap(words, part) for part in index.parts[item]), key=min)
            yield t, item, round(score, 9), q, a  # the order of additions shows beyond that

    def _passages(self, term: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, stop, text) of all passages, half a passage apart, and the numbers of those with a block that can reach the rest."""
        half = PASSAGE // 2
        halves = -(-sizes // half)
        head = np.cumsum(halves) - halves  # number of the first half of each text
        text = np.repeat(np.arange(len(sizes)), halves)
        begin = first[text] + (np.arange(len(text)) - head[text]) * half
        stop = np.minimum(begin + PASSAGE, first[text + 1])
        at = np.flatnonzero((term >= 0) & (self.first[term + 1] > self.first[term]))
        owner = np.searchsorted(first, at, side="right") - 1
        key = np.unique((head[owner] + (at - first[owner]) // half) * len(self.index.terms) + term[at])  # a term once for each half
        which, rare = key // len(self.index.terms), key % len(self.index.terms)
        n = self.first[rare + 1] - self.first[rare]
        entry = np.repeat(self.first[rare] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        which, block, top = np.repeat(which, n), self.blocks[entry], self.maxima[entry]
        # Passage p is made of halves p and p + 1 of its text.
        back = which > head[text[which]]
        which, block, top = np.concatenate([which, which[back] - 1]), np.concatenate([block, block[back]]), np.concatenate([top, top[back]])
        pair, place = np.unique(which * (len(self.index.items) // BLOCK + 1) + block, return_inverse=True)
        able = pair[np.bincount(place, top, len(pair)) >= self.rest - 1e-9] // (len(self.index.items) // BLOCK + 1)
        return begin, stop, text, np.unique(able)

    @staticmethod
    def _overlap(words: np.ndarray, part: tuple[np.ndarray, np.ndarray, int]) -> tuple[float, float]:
        question, answer, n = part
        q = float(np.isin(question, _grams(words, n)).mean()) if len(question) else 1.0
        m = min(GRAM, len(answer))
        return q, float(np.isin(_grams(answer, m), _grams(words, m)).mean()) if m else q  # one word: the question is all there is


def find_leaks(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, leaked) of every item that a passage of a document retrieves.

    Items are indexed by BM25 with impacts as shares of an item's own score.  All passages of all
    documents are queries; passages whose terms cannot reach the threshold are left out by their
    bounds, the others are searched by block-max WAND.  ``leaked``: the whole document holds
    enough of the question's and of the answer's trigrams.  Counts of segments, their mean length
    and the terms' frequencies are those of all items, so results don't depend on ``index_bytes``,
    the size of the indexes that are broadcast one after the other.

    Cases: null or empty texts and items without words find nothing; an item of one word is all
    question; a very long text is searched whole, passage by passage; scores and overlaps just at
    their bounds count; a null doc_id stays null; rows of one doc_id are searched one by one, with
    one result row each, and rows of one item_id with all their texts; an empty benchmark finds
    nothing; extra columns are ignored.
    """
    work = Workspace(docs.sparkSession, "leaks")
    shards, made = IndexShards(benchmark, index_bytes, work), None
    for shard, index in enumerate(shards):
        part = _search(docs, index)
        if len(shards) > 1:  # written, so that only one index is held at a time
            part = work.keep(part, f"found-{shard}")
            index.destroy()
        made = part if made is None else made.unionByName(part)
    return made


class IndexShards:
    """Broadcast indexes that together hold all items, made one at a time: one, unless the benchmark outgrows what may be broadcast."""

    def __init__(self, benchmark: DataFrame, index_bytes: int, work: Workspace):
        self.spark = benchmark.sparkSession
        items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.shards = max(1, -(-size // index_bytes))
        self.items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(self.shards)))
        self.terms = work.keep(self.items.select("shard", "text").mapInArrow(tk.lean(_terms), "shard long, term long, n long, size long"), "terms")
        row = self.terms.filter("term is null").agg(F.sum("n"), F.sum("size")).first()
        self.total, self.words = row[0] or 0, row[1] or 0

    def __len__(self) -> int:
        return self.shards

    def __iter__(self):
        counts = self.terms.filter("term is not null")
        df = counts.groupBy("term").agg(F.sum("n").alias("n"))
        for shard in range(self.shards):
            mine = df.join(counts.filter(F.col("shard") == shard).select("term").distinct(), "term").toArrow()  # of at most index_bytes of text
            known = Statistics(self.total, self.words / max(1, self.total), dict(zip(mine["term"].to_numpy().view(np.uint64).tolist(), mine["n"].to_pylist(), strict=True)))
            rows = self.items.filter(F.col("shard") == shard).select("item_id", "text").collect()
            yield self.spark.sparkContext.broadcast(build_index(sorted((r[0], r[1]) for r in rows), known))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, segments with it, null) and (shard, null, segments, words) of some items."""
    names = ["shard", "term", "n", "size"]
    for b in batches:
        shards = b.column("shard").to_numpy()
        for shard in np.unique(shards).tolist():
            total, size, df = count_terms(b.column("text").filter(pa.array(shards == shard)).to_pylist())
            terms = np.array([*df], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(df), pa.int64()), pa.array(terms), pa.array([*df.values()], pa.int64()), pa.nulls(len(df), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64()), pa.array([size], pa.int64())], names)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without the rows whose text leaks an item, with all their columns as they are; cases as in ``find_leaks``."""
    work = Workspace(docs.sparkSession, "leaks")
    shards = IndexShards(benchmark, index_bytes, work)
    for shard, index in enumerate(shards):
        rest = docs.mapInArrow(tk.lean(_without(index)), docs.schema)
        if len(shards) > 1:
            rest = work.keep(rest, f"rest-{shard}")
            index.destroy()
            work.drop(docs)
        docs = rest
    return docs


def _without(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(index.value)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, _, buf, offs in tk.slices(b.column("text")):
                for t, _, _, q, a in searcher.search(buf, offs):
                    if q >= QUESTION and a >= ANSWER:
                        keep[i + t] = False
            yield b.filter(pa.array(keep))

    return run


def _search(docs: DataFrame, index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(index.value)
        for b in batches:
            ids = b.column("doc_id")
            for i, _, buf, offs in tk.slices(b.column("text")):
                rows = list(searcher.search(buf, offs))
                if rows:
                    t, item, score, q, a = zip(*rows, strict=True)
                    leaked = [x >= QUESTION and y >= ANSWER for x, y in zip(q, a, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + x for x in t])), pa.array(item, pa.int64()), pa.array(score), pa.array(q), pa.array(a), pa.array(leaked)],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leaked"],
                    )

    return docs.select("doc_id", "text").mapInArrow(tk.lean(run), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, leaked boolean")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and items that are leaks."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter("leaked").drop("leaked")
