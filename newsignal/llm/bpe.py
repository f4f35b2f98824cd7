"""Byte-level BPE by a dynamic program over byte prefixes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textkit import give_back, slices

#: Distinct pieces whose encoding a worker keeps, and the longest that is kept, in bytes.
CACHE, CACHED_PIECE = 500_000, 64
#: Neighbours that a worker remembers.
PAIRS = 500_000
#: The same where other stages share the workers: (pieces, neighbours).
SMALL = 120_000, 150_000
#: Texts are worked on together up to so many bytes.
BATCH_BYTES = 1 << 20
# Fixed value: the usual pattern of byte-level vocabularies.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_IDS, _SHOWN = itemgetter(0), itemgetter(1)


class Vocabulary:
    """Ranks of tokens, and which neighbours the merges leave side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every ending of a token: its own rank, or -1 if it is none.
        self.endings = {t[k:]: -1 for t in ranks for k in range(len(t))} | ranks
        #: What was asked lately, and what was asked before that: when the first is half of ``most_pairs`` it becomes the second.
        self.most_pairs = PAIRS
        self.pairs: dict[tuple[int, int], bool] = {}
        self.older: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a ``.tiktoken`` file: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a short text by its definition: merge the lowest-ranked neighbours until none is left."""
        rank, none = self.ranks.get, len(self.ranks) + (1 << 40)
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [rank(text[i : i + 2], none) for i in range(len(text) - 1)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        """Whether merges ever make this token."""
        known = self.reachable.get(token)
        if known is None:
            known = self.reachable[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a, b again."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.older.get((a, b))
            if known is None:
                known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.pairs[a, b] = known
            if len(self.pairs) >= self.most_pairs // 2:
                self.older, self.pairs = self.pairs, {}
        return known


class Prefixes:
    """One piece of text with the last token of each of its byte prefixes.

    A prefix has exactly one last token whose neighbour, the last token of what is left before it,
    may stand beside it.  So bytes can be appended without looking back further than one token,
    and after an edit only prefixes near it have to be worked out again.
    """

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = []
        self.append(text)

    def _extend(self, end: int) -> int:
        """Append the last token of the first ``end`` bytes; of the tokens that end there the longest is tried first."""
        v, text, last = self.vocabulary, self.text, self.last
        ending, pairs = v.endings.get, v.pairs.get
        found = []
        for start in range(end - 1, -1, -1):
            token = ending(text[start:end])
            if token is None:
                break
            if token >= 0:
                found.append((start, token))
        for start, token in reversed(found):
            if not start:
                fits = v.alone(token)
            else:  # a token that merges never make stands beside none
                before = last[start - 1]
                fits = pairs((before, token))
                if fits is None:
                    fits = v.side_by_side(before, token)
            if fits:
                last.append(token)
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        self.text += more
        for end in range(len(self.last) + 1, len(self.text) + 1):
            self._extend(end)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; returns how many prefixes were worked out again."""
        tail = self.last[stop:]
        self.text = self.text[:start] + new + self.text[stop:]
        del self.last[start:]
        need = self.vocabulary.longest  # so many equal neighbours, and all after them are as before
        same = done = 0
        offset = start + len(new)
        for end in range(start + 1, len(self.text) + 1):
            token = self._extend(end)
            done += 1
            at = end - 1 - offset
            same = same + 1 if at >= 0 and tail[at] == token else 0
            if same >= need:
                self.last += tail[at + 1 :]
                break
        return done

    def become(self, text: bytes) -> None:
        """Change to ``text``, keeping the prefixes that the two share."""
        same = len(commonprefix((self.text, text)))
        self.text = text[:same]
        del self.last[same:]
        self.append(text[same:])

    def tokens(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


def latin_class(kind: str) -> str:
    """The characters up to U+024F that ``regex`` puts in a class, as ranges for ``re``."""
    found = [c for c in range(0x250) if regex.match(kind, chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that finds the pattern's matches in a text.

    For the usual byte-level pattern a text of Latin letters goes through an equal expression for
    ``re``, which is faster: its classes are spelt out for characters up to U+024F, and words come
    first, which changes nothing as no contraction begins like one.
    """
    every = regex.compile(pattern).findall
    if pattern != _BYTE_LEVEL:
        return every
    letter, digit, space = latin_class(r"\p{L}"), latin_class(r"\p{N}"), latin_class(r"\s")
    latin = re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    other = re.compile("[^\u0000-\u024f]").search
    return lambda text: every(text) if other(text) else latin(text)


class Encoder:
    """A bounded cache, piece -> (ids, ids as decimal text), in front of ``Prefixes``."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, cache: int = CACHE, pairs: int = PAIRS):
        self.vocabulary, self.most = vocabulary, cache
        vocabulary.most_pairs = pairs
        #: Pieces of late, and those before them, as for neighbours.
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self.split = splitter(pattern)

    def learn(self, pieces: set[str]) -> dict[str, tuple[tuple[int, ...], str]]:
        """Encode pieces; in sorted order each takes over the prefixes that it shares with the one before."""
        found, table, ranks = {}, Prefixes(self.vocabulary), self.vocabulary.ranks
        for raw in sorted(p.encode("utf-8", "surrogatepass") for p in pieces):
            whole = ranks.get(raw)
            if whole is None:
                table.become(raw)
                ids = tuple(table.tokens())
            else:
                ids = (whole,)
            found[raw.decode("utf-8", "surrogatepass")] = ids, " ".join(map(str, ids))
        return found

    def forget(self) -> None:
        """Let go of all pieces and neighbours that are remembered."""
        self.cache, self.older = {}, {}
        self.vocabulary.pairs, self.vocabulary.older = {}, {}

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, ids in decimal joined by spaces) of each whole text."""
        split = [self.split(t) for t in texts]
        every = set().union(*split)
        new = every.difference(self.cache)
        again = new.intersection(self.older)
        found = self.learn(new - again)
        self.cache.update(found)
        self.cache.update((p, self.older[p]) for p in again)
        for pieces in split:
            got = list(map(self.cache.__getitem__, pieces))
            yield list(chain.from_iterable(map(_IDS, got))), " ".join(map(_SHOWN, got))
        for piece in [p for p in found if len(p) > CACHED_PIECE]:
            del self.cache[piece]
        if len(self.cache) >= self.most // 2:
            self.older, self.cache = self.cache, {}

    def encode(self, text: str) -> tuple[list[int], str]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, cache: int = CACHE, pairs: int = PAIRS) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(Vocabulary.load(path), pattern, cache, pairs)


def encode_texts(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, cache: int = CACHE, pairs: int = PAIRS, forget: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array of int).

    Each match of ``pattern`` is encoded by itself, from the last tokens of its byte prefixes;
    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the bytes that
    the ids decode to.  ``path`` is read on every worker: the vocabulary is part of the installation.
    ``cache`` and ``pairs`` bound what a worker remembers, with ``forget`` until its task ends; the
    result is the same with any.

    Cases: a null or empty text has no ids, and the digests of no bytes; a very long text is
    encoded whole; repeated rows are encoded alike; columns of the same names are replaced, all
    others stay; an empty table stays empty.
    """
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    new = ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, cache, pairs)

        def out(rows: pa.RecordBatch, got: list) -> pa.RecordBatch:
            arrays = [*rows.columns, pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            names = [*rows.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays, names = [*arrays, pa.array([g[3] for g in got], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        try:
            for b in batches:
                for i, j, _, _ in slices(b.column("text"), BATCH_BYTES):
                    got = []
                    for ids, shown in enc.encode_all([t or "" for t in b.column("text")[i:j].to_pylist()]):
                        decoded = enc.decode(ids)
                        got.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids if keep_ids else None))
                    yield out(b[i:j], got)
        finally:
            if forget:
                enc.forget()
            give_back()

    return docs.mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_vocabulary(), keep_ids=False).drop("text")
