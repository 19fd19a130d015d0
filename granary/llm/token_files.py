"""Token ids in bit-packed files: encode, write in document order, read back.

A file is one binary value, held as a row of a Parquet table with the range of
documents it covers, so that any store that Spark writes to can hold it::

    4s  magic "GTK1"
    u1  bits an id takes          (the least that the vocabulary fits into)
    u4  ids in a block
    u4  documents
    u8  ids
    u4 x documents   ids of each document, its end id included
    u8 x blocks + 1  byte offset of each block within the packed part
    packed ids; each block begins at a byte

An index beside the files gives the number of ids before each. All numbers
are little-endian. A block's bytes unpack at once in numpy, and
an id's place follows from its number alone, so any span of ids can be read
without the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.scratch import map_batches, shared_path

_HEAD = struct.Struct("<4sBIIQ")
BLOCK_IDS = 4096
#: Characters of text for a file.
FILE_CHARS = 4 << 20
#: Bytes, about, of the words and pieces of words whose ids a Python worker remembers; what an entry and a character of it take, about.
CACHE_BYTES, _ENTRY_BYTES, _CHAR_BYTES = 96 << 20, 200, 8
#: Words of a text that are looked up together.
_SLICE = 1 << 16
_WIDE_BITS = 12


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (uint32) in ``bits`` bits each, lowest bit first, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.zeros((n, 32), dtype=np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def to_file(docs: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file of the given documents' ids."""
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    lengths = np.array([len(d) for d in docs], dtype="<u4")
    offsets = np.cumsum([0, *(len(b) for b in blocks)], dtype="<u8")
    return b"".join((_HEAD.pack(b"GTK1", bits, block, len(docs), len(ids)), lengths.tobytes(), offsets.tobytes(), *blocks))


class TokenFile:
    """Random access to one file's ids."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != b"GTK1":
            raise ValueError("not a token file")
        self.lengths = np.frombuffer(data, "<u4", n_docs, _HEAD.size).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        at = _HEAD.size + 4 * n_docs
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block) + 1, at).astype(np.int64)
        self.packed = memoryview(data)[at + 8 * len(self.offsets) :]

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of this file; only their blocks are unpacked."""
        if b <= a:
            return np.zeros(0, dtype=np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        parts = [unpack(self.packed[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last + 1)]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


# Texts of only these characters fall into pieces that the tokenizer treats each on its own: the white space between
# words is dropped, letters here are lower-cased one to one, and no character combines with another. Other texts are
# cut at white space only. Either way each distinct piece is encoded by the tokenizer itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\r a-z0-9ß-öø-ÿ]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Byte-level tokenizers' letters for bytes: printable Latin-1 stands for itself, the other bytes for U+0100 and on in turn.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: b if b in _PRINTABLE else 256 + b - sum(x < b for x in _PRINTABLE) for b in range(256)}
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pieces between white space are independent (word-end BPE).

    Remembers the ids of words, and of the pieces that words are made of, in
    about ``cache`` bytes, counted before they are added; a memory that would grow beyond
    is emptied first. Only a slice of words that needs more by itself exceeds it.
    """

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[-1] if self.special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else -1
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode pieces, many to a call, with a special token between them as a mark."""
        out = {}
        lumps = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        for lump, found in zip(lumps, self.tokenizer.encode_batch_fast([self.mark.join(x) for x in lumps], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(lump) - 1:
                raise ValueError("a piece holds a special token")
            for piece, a, b in zip(lump, [0, *(cuts + 1)], [*cuts, len(ids)]):
                out[piece] = ids[a:b].tobytes()
        return out

    def _piece(self, piece: str) -> bytes:
        """A piece of a plain text is what the tokenizer's normaliser and splitter would hand to its model: ask the model."""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _learn(self, words: list[str], plain: bool) -> None:
        memory = self.words
        while True:
            new = set(words).difference(memory)
            # A word of letters alone is one piece, and a piece is remembered like a word.
            cut = {w: _PIECES.findall(w) for w in new if not w.isalpha()} if plain else {}
            pieces = (new - cut.keys()).union(set(chain.from_iterable(cut.values())).difference(memory)) if plain else new
            cost = sum(_ENTRY_BYTES + _CHAR_BYTES * len(w) for x in (pieces, cut) for w in x)
            if self.held + cost <= self.most or not memory:
                break
            memory.clear()
            self.held = 0
        self.held += cost
        if not plain:
            memory.update(self._encoded(list(new)))
            return
        for piece in pieces:
            memory[piece] = self._piece(piece)
        memory.update((w, b"".join(map(memory.__getitem__, x))) for w, x in cut.items())

    def encode(self, text: str) -> np.ndarray:
        if self.mark is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        plain = _PLAIN.fullmatch(text) is not None
        words, parts = text.lower().split() if plain else _WORDS.findall(text), []
        for at in range(0, len(words), _SLICE):
            some = words[at : at + _SLICE]
            if set(some).difference(self.words):
                self._learn(some, plain)
            parts.append(b"".join(map(self.words.__getitem__, some)))
        return np.frombuffer(b"".join(parts), dtype="<u4")


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, vocabulary: int = 49408, file_chars: int = FILE_CHARS) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) as token files under ``path``, in ascending doc_id order.

    ``path``/files has rows (range, seq, n_ids, doc_ids, file), ``path``/index
    (range, seq, start): a file's place and the ids before it. Sampling cuts the documents by
    doc_id (nulls first) into ranges of about ``file_chars`` characters, one
    or more files each; rows that share a doc_id are ordered by a hash of their
    texts, and may lie in several ranges, however many they are. Null texts are empty: only the end id. An empty table gives no file. Other
    columns are ignored. The tokenizer's file name is opened where a task runs.
    """
    bits = bits_for(vocabulary)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = texts.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    ranged = ordered.repartitionByRange(1 + size // file_chars, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").drop("h", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path(tokenizer)).encode, np.array([end_id], dtype=np.uint32)
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held, seq, number = 0, 0, TaskContext.get().partitionId()  # ranges are in order

        def flush() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in ((number, pa.int32()), (seq, pa.int32()), (sum(map(len, parts)), pa.int64()), (doc_ids, pa.list_(pa.int64())), (to_file(parts, bits), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["range", "seq", "n_ids", "doc_ids", "file"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encode(text := text.as_py())
                doc_ids.append(doc_id.as_py())
                parts.append(np.concatenate((ids, end)))
                held += len(text)
                if held >= file_chars:
                    yield flush()
                    doc_ids, parts, held, seq = [], [], 0, seq + 1
        if parts:
            yield flush()

    map_batches(ranged, run, "range int, seq int, n_ids long, doc_ids array<long>, file binary").write.parquet(f"{path}/files")
    # Running sums in two steps: over some thousand ranges' files, and over the sums of these.
    sizes = docs.sparkSession.read.parquet(f"{path}/files").select("range", "seq", "n_ids", F.shiftright("range", _WIDE_BITS).alias("wide"))
    far = Window.orderBy("wide").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = Window.partitionBy("wide").orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = sizes.groupBy("wide").agg(F.sum("n_ids").alias("n")).select("wide", (F.sum("n").over(far) - F.col("n")).alias("before"))
    starts = sizes.withColumn("within", F.sum("n_ids").over(near) - F.col("n_ids")).join(wide, "wide")
    starts.select("range", "seq", (F.col("before") + F.col("within")).alias("start")).write.parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(start, doc_ids, file). Spark broadcasts the index while it is under its size threshold."""
    files, index = spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/index")
    return files.join(index, ["range", "seq"]).select("start", "doc_ids", "file")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start long, ids array<long>) for every document in the files under ``path``, unpacked from their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, doc_ids, file in _files(batches):
            for a, b in _runs(file):
                span = file.ids(int(file.first[a]), int(file.first[b]))
                lengths = pa.array(np.concatenate(([0], np.cumsum(file.lengths[a:b]))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(start + file.first[a:b], pa.int64()), pa.ListArray.from_arrays(lengths, pa.array(span, pa.int64()))], ["doc_id", "start", "ids"])

    return map_batches(_stored(spark, path), run, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document in the files under ``path``, from the unpacked ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, doc_ids, file in _files(batches):
            crcs = []
            for a, b in _runs(file):
                data = memoryview(file.ids(int(file.first[a]), int(file.first[b])).astype("<u4").tobytes())
                cuts = 4 * (file.first[a : b + 1] - file.first[a])
                crcs += [zlib.crc32(data[x:y]) for x, y in zip(cuts, cuts[1:])]
            columns = (doc_ids, start + file.first[:-1], file.lengths, crcs)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(_stored(spark, path), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, TokenFile]]:
    for batch in batches:
        for start, doc_ids, data in zip(*batch.columns):
            yield start.as_py(), doc_ids.as_py(), TokenFile(data.as_py())


def _runs(file: TokenFile, ids: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Documents in runs of about so many ids."""
    a, n = 0, len(file.lengths)
    while a < n:
        b = max(a + 1, int(np.searchsorted(file.first, file.first[a] + ids, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def written_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, vocabulary: int = 49408) -> DataFrame:
    """Write ``docs`` to new token files in the shared folder and report on what is read back from them."""
    spark = docs.sparkSession
    write_tokens(docs, path := shared_path(spark, "tokens"), tokenizer, end_id, vocabulary)
    return token_digests(spark, path)
