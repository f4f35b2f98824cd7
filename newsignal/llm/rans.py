"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

Format, version 1.  A file set is a folder with two folders of Parquet parts, so that it can lie in
any store that Spark reaches and a task that is run again replaces what it wrote.  Each row of
``blocks`` is one block: whole documents of one shard, encoded by themselves with frequency tables
that all blocks share.  The one row of ``tables`` holds these: ``version``, ``scale`` (SCALE), ``size``
(symbols of the vocabulary), ``crc`` (CRC-32 of the frequencies), ``frequencies`` (u32 of each symbol).
A file set is decoded from these files alone.

``header`` (little-endian): magic ``NSR1``, lanes (u32), tokens (u64), documents (u64), number of
checkpoints (u32), number of payload words (u64), tokens of the shard before this block (u64), CRC-32
of the payload (u32), CRC-32 of the ids (u32).  ``lengths``: tokens of each document (u64).  ``payload``: u32 words in reading order.
``checkpoints``: for every ``CHECKPOINT`` steps the word position (u64) and the states of all lanes
(u64), so that decoding can start there; the first one stands at step 0.

Token k of a block is coded by lane ``k % lanes`` at step ``k // lanes``.  A lane's state x lies in
[2^31, 2^63): decoding takes the slot x mod 2^SCALE, looks up its symbol, and reads one word when
x falls below 2^31, lanes in ascending order.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, shared_dir, table
from .textkit import per_text, slices

VERSION, SCALE, LANES, CHECKPOINT = 1, 22, 512, 256
#: Documents join a block until it has so many tokens; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 17
#: Aim for so many bytes of ids in one shard, which one task writes.
SHARD_BYTES = 16 << 20
#: Texts are tokenized together up to so many bytes; distinct pieces whose ids a worker keeps.
BATCH_BYTES, CACHE = 4 << 20, 800_000
_LOW = np.uint64(1 << 31)
#: Classes of characters that the vocabulary's pattern tells apart.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
# The normaliser and the pattern of the lower-casing vocabulary.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_HEADER = struct.Struct("<4sIQQIQQII")
_TABLES = "version int, scale int, size int, crc long, frequencies binary"


class Frequencies:
    """Frequencies of all symbols that sum up to 2^SCALE, each at least 1; made from counts, or from nothing."""

    def __init__(self, counts: np.ndarray):
        total, size = 1 << SCALE, len(counts)
        if size > total // 2:
            raise ValueError("more symbols than the scale can hold")
        share = counts / max(1, counts.sum())
        f = 1 + np.floor(share * (total - size)).astype(np.int64)
        f[int(np.argmax(f))] += total - int(f.sum())  # what rounding left goes to the first of the most frequent
        self._set(f)

    def _set(self, f: np.ndarray) -> None:
        self.freq = f.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    def row(self) -> tuple[int, int, int, int, bytes]:
        """The row that stores the frequencies: version, scale, size, crc, frequencies."""
        raw = self.freq.astype("<u4").tobytes()
        return VERSION, SCALE, len(self.freq), zlib.crc32(raw), raw

    @classmethod
    def of_row(cls, version: int, scale: int, size: int, crc: int, frequencies: bytes) -> Frequencies:
        """The frequencies that a row stores; another format, or a wrong checksum, is an error."""
        if version != VERSION or scale != SCALE:
            raise ValueError(f"tables of version {version} and scale {scale}")
        f = np.frombuffer(frequencies, "<u4").astype(np.int64) if len(frequencies) == 4 * size else None
        if f is None or zlib.crc32(frequencies) != crc or int(f.sum()) != 1 << SCALE or int(f.min()) < 1:
            raise ValueError("damaged frequency tables")
        made = cls.__new__(cls)
        made._set(f)
        return made

    @property
    def slots(self) -> np.ndarray:
        """The symbol of each slot."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table_: Frequencies, lanes: int = LANES) -> tuple[bytes, bytes, int]:
    """(payload, checkpoints, number of checkpoints) of the ids; coded from the last step to the first."""
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    scale, low = np.uint64(SCALE), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        n = len(s)
        f, c, y = table_.freq[s], table_.start[s], x[:n]
        over = y >= f << np.uint64(63 - SCALE)
        if over.any():
            out = y[over]
            chunks.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            written += len(out)
            y[over] = out >> low
        q = y // f
        x[:n] = (q << scale) + (y - q * f) + c
        if step % CHECKPOINT == 0:
            marks.append((written, x.copy()))
    payload = np.concatenate(chunks)[::-1] if chunks else np.empty(0, np.uint32)
    marks.reverse()
    points = b"".join(struct.pack("<Q", written - at) + state.astype("<u8").tobytes() for at, state in marks)
    return payload.astype("<u4").tobytes(), points, len(marks)


def decode_block(payload: bytes, checkpoints: bytes, tokens: int, table_: Frequencies, lanes: int = LANES, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids between two checkpoints (all of them by default): pieces between checkpoints can be decoded side by side."""
    words = np.frombuffer(payload, "<u4")
    size = 8 + 8 * lanes
    count = len(checkpoints) // size
    if first >= count:
        return np.empty(0, np.uint32)
    at = struct.unpack_from("<Q", checkpoints, first * size)[0]
    x = np.frombuffer(checkpoints, "<u8", lanes, first * size + 8).copy()
    steps = -(-tokens // lanes)
    stop = min(steps, (count if last is None else last) * CHECKPOINT)
    begin = first * CHECKPOINT
    out = np.empty(max(0, min(tokens, stop * lanes) - begin * lanes), np.uint32)
    mask, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    slots, freq, start = table_.slots, table_.freq, table_.start
    for step in range(begin, stop):
        n = min(lanes, tokens - step * lanes)
        y = x[:n]
        slot = y & mask
        s = slots[slot]
        out[(step - begin) * lanes : (step - begin) * lanes + n] = s
        y = freq[s] * (y >> scale) + slot - start[s]
        under = y < _LOW
        need = int(np.count_nonzero(under))
        if need:
            y[under] = (y[under] << low) | words[at : at + need]
            at += need
        x[:n] = y
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, table_: Frequencies, ahead: int = 0) -> dict[str, bytes]:
    """The columns of one block."""
    payload, points, count = encode_block(ids, table_)
    header = _HEADER.pack(b"NSR1", LANES, len(ids), len(lengths), count, len(payload) // 4, ahead, zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes()))
    return {"header": header, "lengths": lengths.astype("<u8").tobytes(), "payload": payload, "checkpoints": points}


def unpack(header: bytes, lengths: bytes, payload: bytes, checkpoints: bytes, table_: Frequencies) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, lengths, tokens of the shard before it) of one block; a wrong checksum is an error."""
    magic, lanes, tokens, docs, _, words, ahead, crc, crc_ids = _HEADER.unpack(header)
    if magic != b"NSR1" or len(payload) != 4 * words or len(lengths) != 8 * docs or zlib.crc32(payload) != crc:
        raise ValueError("a damaged block")
    ids = decode_block(payload, checkpoints, tokens, table_, lanes)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("a block that doesn't decode to its ids")
    return ids, np.frombuffer(lengths, "<u8").astype(np.int64), ahead


def id_kind(size: int) -> np.dtype:
    """How ids below ``size`` are held between stages: as u16 if that is enough."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def beyond_latin(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have a character beyond U+017F, after which lower case can leave the Latin blocks, or U+0130, which lower-cases to two."""
    far = buf > 0xC5  # U+0180 is C6 80
    far[1:] |= (buf[1:] == 0xB0) & (buf[:-1] == 0xC4)
    return per_text(far, offs) > 0


class WordTokenizer:
    """The tokenizers library behind a bounded cache of the pieces that its vocabulary splits texts into.

    For the lower-casing vocabulary with word ends, texts of Latin letters are lowered and split on
    their bytes by rules equal to the vocabulary's own expression (both act on single characters
    there), and the library's model encodes each distinct piece once.  Any other text, and any other
    vocabulary, is encoded by the library as a whole.  With ``added``, what stands for an added
    token in a text becomes that token, as the library does by default, and such a text is encoded
    by the library as a whole too.
    """

    def __init__(self, path: str, plain: bool = False, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.size = self.tokenizer.get_vocab_size()
        self.kind = id_kind(self.size)
        parts = json.loads(self.tokenizer.to_str())
        # Special tokens are only ids where the library looks for them; others, and those that the normaliser may make, always are.
        looked = [t for t in parts["added_tokens"] if added or not t["special"]]
        self.added = [t["content"] for t in looked]
        self.plain = plain or any(t["normalized"] for t in looked) or parts["normalizer"] != _NORMALIZER or parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _SPLIT}
        self.pieces: dict[str, bytes] = {}
        self.classes = np.full(0x250, _SIGN, np.uint8)
        for kind, expression in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")):
            self.classes[[c for c in range(0x250) if regex.match(expression, chr(c))]] = kind
        self.letters = _byte_letters()
        self.raw = [k.to_bytes(self.kind.itemsize, "little") for k in range(self.size)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece by the library's model, which writes bytes as letters; ASCII letters and signs stand for themselves."""
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.tokenizer.model.tokenize(shown)])

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces of all texts one after another, number of the first piece of each text and after the last); Latin texts without nulls."""
        if not len(texts):
            return texts, np.zeros(1, np.int64)
        _, _, buf, offs = next(slices(pc.utf8_lower(texts), 1 << 40))
        if not len(buf):
            return texts[:0], np.zeros(len(offs), np.int64)
        kind = self.classes[buf]
        lead = np.flatnonzero(buf >= 0xC0)  # of two bytes each
        kind[lead] = kind[lead + 1] = self.classes[(buf[lead].astype(np.int64) & 0x1F) << 6 | buf[lead + 1] & 0x3F]
        opens = np.zeros(len(buf) + 1, bool)  # where a text begins or the last one ends
        opens[offs] = True
        begin = opens[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        begin |= kind == _DIGIT
        begin &= (kind != _SPACE) & ((buf & 0xC0) != 0x80)
        # Contractions: a lone apostrophe takes one or two of the letters after it.
        mark = np.flatnonzero((buf == ord("'")) & begin)
        mark = mark[~opens[mark + 1]]
        one = mark[np.isin(buf[mark + 1], np.frombuffer(b"stmd", np.uint8))]
        two = mark[~opens[np.minimum(mark + 2, len(buf))]]
        x, y = buf[two + 1], buf[two + 2]
        two = two[((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))]
        for at, letters in ((one, 1), (two, 2)):
            begin[at + 1] = False
            after = at + 1 + letters
            after = after[~opens[after]]
            begin[after[kind[after] == _LETTER]] = True
        starts = np.flatnonzero(begin)
        shown = kind != _SPACE
        before = np.cumsum(shown, dtype=np.int32)
        places = np.concatenate([before[starts] - 1, before[-1:]])
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(buf[shown])), np.searchsorted(starts, offs)

    def _ids_of(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct pieces; pieces up to 64 characters are kept."""
        found = list(map(self.pieces.get, distinct))
        new = [k for k, x in enumerate(found) if x is None]
        if len(self.pieces) + len(new) > CACHE:
            self.pieces = {}
        for k in new:
            piece = distinct[k]
            found[k] = ids = self._piece(piece)
            if len(piece) <= 64:
                self.pieces[piece] = ids
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); null counts as empty."""
        texts = pc.fill_null(texts, "")
        alone = np.full(len(texts), self.plain)  # texts for the library as a whole
        if not self.plain:
            for i, j, buf, offs in slices(texts):
                alone[i:j] = beyond_latin(buf, offs)
            for content in self.added:
                alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        whole = {k: self._whole(texts[k].as_py()) for k in np.flatnonzero(alone).tolist()}
        pieces, first = self.split(pc.if_else(pa.array(alone), "", texts) if whole else texts)
        coded = pieces.dictionary_encode()
        number = coded.indices.to_numpy()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # The ids of all pieces, each taken from where its piece lies among the distinct ones.
        store = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        sizes = size[number]
        last = np.concatenate([[0], np.cumsum(sizes)])
        ids = store[np.repeat((np.cumsum(size) - size)[number] - last[:-1], sizes) + np.arange(last[-1])]
        cuts = last[first]
        if whole:
            parts = [whole[k] if k in whole else ids[cuts[k] : cuts[k + 1]] for k in range(len(texts))]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.diff(cuts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        ids, lengths = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


_LOADED: dict[tuple[str, bool, bool], WordTokenizer] = {}


def _tokenizer(path: str, plain: bool, added: bool) -> WordTokenizer:
    if (path, plain, added) not in _LOADED:
        _LOADED[path, plain, added] = WordTokenizer(path, plain, added)
    return _LOADED[path, plain, added]


def tokenize(docs: DataFrame, path: str, end_id: int, plain: bool = False, added: bool = False) -> DataFrame:
    """doc_id and ids (little-endian, ``end_id`` last) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path, plain, added)
        width = tok.kind.itemsize
        for b in batches:
            for i, j, _, _ in slices(b.column("text"), BATCH_BYTES):
                ids, lengths = tok.encode_column(b.column("text")[i:j])
                cuts = np.concatenate([[0], np.cumsum(lengths + 1)])
                every = np.full(cuts[-1], end_id, tok.kind)
                inner = np.ones(cuts[-1], bool)
                inner[cuts[1:] - 1] = False
                every[inner] = ids
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(width * cuts), pa.py_buffer(every)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], held.cast(pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in all documents: one row for each id and task at most is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for _, _, buf, _ in slices(b.column("ids")):
                counts += np.bincount(np.frombuffer(buf.tobytes(), id_kind(size)), minlength=size)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["id", "n"])

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def write_blocks(tokens: DataFrame, table_: Frequencies, path: str, shards: int) -> None:
    """Write (doc_id, ids) as a file set, shards and blocks in ascending doc_id order (null first)."""
    spark = tokens.sparkSession
    spark.createDataFrame([table_.row()], _TABLES).coalesce(1).write.parquet(f"{path}/tables")
    shared = spark.sparkContext.broadcast(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, ahead = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held, kind = 0, id_kind(len(shared.value.freq))

        def block() -> pa.RecordBatch:
            nonlocal number, ahead, held
            ids = np.frombuffer(b"".join(parts), kind)
            row = pack(ids, np.array([len(p) // kind.itemsize for p in parts]), shared.value, ahead)
            made = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs[:]], pa.list_(pa.int64())), *(pa.array([v], pa.binary()) for v in row.values())],
                ["shard", "block", "n_tokens", "doc_ids", *row],
            )
            number, ahead, held = number + 1, ahead + len(ids), 0
            docs.clear(), parts.clear()
            return made

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                docs.append(doc)
                parts.append(ids.as_py())
                held += len(parts[-1]) // kind.itemsize
                if held >= BLOCK_TOKENS:
                    yield block()
        if docs:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ordered = tokens.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(run, "shard int, block int, n_tokens long, doc_ids array<long>, header binary, lengths binary, payload binary, checkpoints binary").write.parquet(f"{path}/blocks")


def read_tables(spark: SparkSession, path: str) -> Frequencies:
    """The frequency tables of a file set."""
    found = spark.read.schema(_TABLES).parquet(f"{path}/tables").take(2)
    if len(found) != 1:
        raise ValueError("a file set has one row of tables")
    return Frequencies.of_row(*found[0])


def read_blocks(spark: SparkSession, path: str, table_: Frequencies | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in a file set.

    The frequency tables come from the file set, if they aren't given.  Blocks are decoded independently of each other.  Where a block starts comes from its header
    and the sizes of the shards before its own, of which the driver holds one number each.
    """
    table_ = table_ or read_tables(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a shard
    before, at = {}, 0
    for shard in sorted(sizes):
        before[shard] = at
        at += sizes[shard]
    shared = spark.sparkContext.broadcast((table_, before))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, before = shared.value
        for b in batches:
            for row in range(b.num_rows):
                r = {n: b.column(n)[row].as_py() for n in b.schema.names}
                ids, lengths, ahead = unpack(r["header"], r["lengths"], r["payload"], r["checkpoints"], freq)
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                arrays = [pa.array(r["doc_ids"], pa.int64()), pa.array(cuts[:-1] + (before[r["shard"]] + ahead)), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array([ids[x:y].astype(np.int32) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return blocks.select("shard", "doc_ids", "header", "lengths", "payload", "checkpoints").mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, plain: bool = False, added: bool = False) -> Frequencies:
    """Tokenize, count the ids of all documents for the shared tables, and write the file set; returns the tables.

    Cases: a null or empty text is the end id alone; null doc_ids come first; rows of one doc_id
    are ordered by a hash of their ids, repeated ones all stay; extra columns are ignored; an empty table
    makes an empty file set.  An added token's content in a text becomes its id with ``added`` (the
    library's default), else it is split like other words.
    """
    size = _tokenizer(vocabulary, plain, added).size
    tokens = materialise(tokenize(docs, vocabulary, end_id, plain, added), "ids")
    table_ = Frequencies(count_ids(tokens, size))
    held = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    write_blocks(tokens, table_, path, max(1, -(-held // SHARD_BYTES)))
    return table_


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/newsignal/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, added=True)
    return read_blocks(spark, path)
