"""Token ids in fixed-width bit-packed files.

File: the magic bytes, then blocks of ``BLOCK`` ids, each id in the fewest bits that hold the vocabulary,
little-endian bit order, every block on a byte boundary; then a footer in JSON and int64 arrays: document ids,
end of each document in ids, byte offset of each block; then the footer's offset (8 bytes).  Any range of ids is
read from the blocks that hold it and unpacked by numpy.

Files hold documents in ascending id (nulls first); file k holds no larger id than file k + 1.  Which files count
is said by the manifest that the successful tasks return, so a task that runs twice leaves a stray file at worst.

Defined cases: a null text is empty and holds the end id alone; repeated ids stay, in any order among themselves;
an empty table writes no file and gives an empty result; long texts are encoded whole, words with a bounded cache;
other columns are never read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import files
from pagemill.llm.scratch import Scratch, batches_of
from pagemill.llm.words import word_lists

MAGIC = b"PMTOKBIN"
BLOCK = 1 << 16
#: Blocks read at once.
RUN = 16
#: Words whose ids a process keeps, and the length from which a word isn't kept.
KEPT_WORDS, LONG_WORD = 1_000_000, 64
#: What sets words apart when many are encoded in one call (a word of its own), and how many are.
MARK, LINE = b" \x01 ", 256
#: Words looked up together.
GROUP = 200_000
#: Bytes of texts that a worker is sent at once.
BATCH = "4m"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class Encoder:
    """Ids of whole texts, word by word.

    The tokenizer must drop white space and let no token, normalisation or special token reach across it;
    then a text's ids are those of its words in order, and frequent words are encoded once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size(with_added_tokens=True)
        self.index: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.empty(1 << 16, np.uint32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.used = 0
        mark = self.model.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their numbers; many words go into one call, set apart by a mark that none of them holds."""
        lines = [MARK.join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        if self.mark is not None and not any(MARK[1:2] in w for w in words):
            flat, size = [], []
            for line in self.model.encode_batch_fast([x.decode() for x in lines], add_special_tokens=False):
                ids = np.array(line.ids, dtype=np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                size.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                flat.append(ids[ids != self.mark])
            return np.concatenate(flat), np.concatenate(size)
        found = [e.ids for e in self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words behind those that are there."""
        flat, size = self._ids(words)
        old, count, need = len(self.index), len(self.index) + len(words), self.used + int(size.sum())
        if need > self.flat.size:
            self.flat = np.concatenate([self.flat, np.empty(max(self.flat.size, need), np.uint32)])
        if count > self.start.size:
            more = np.empty(max(self.start.size, count), np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.flat[self.used : need] = flat
        self.start[old:count], self.size[old:count] = self.used + np.cumsum(size) - size, size
        self.index.update(zip(words, range(old, count), strict=True))
        self.used = need

    def _resolve(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        index = self.index
        new = list(set(chain.from_iterable(lists)).difference(index))
        short = [w for w in new if len(w) <= LONG_WORD][: max(0, KEPT_WORDS - len(index))]
        if short:
            self._learn(short)
        kept, used = len(index), self.used
        passing = [w for w in new if w not in index]
        if passing:
            self._learn(passing)
        out = []
        for words in lists:
            at = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
            size = self.size[at]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1])] if len(words) else np.empty(0, np.uint32))
        for w in passing:
            del index[w]
        assert len(index) == kept
        self.used = used
        return out

    def encode_many(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        lists, of, ready, words = [], [], 0, 0
        held: list[np.ndarray] = []

        def resolved(last: bool):
            nonlocal held, ready
            for i, ids in zip(of, self._resolve(lists), strict=True):
                while ready < i:
                    yield np.concatenate(held) if held else np.empty(0, np.uint32)
                    held, ready = [], ready + 1
                held.append(ids)
            if last:
                while ready < n:
                    yield np.concatenate(held) if held else np.empty(0, np.uint32)
                    held, ready = [], ready + 1

        n = 0
        for i, text in enumerate(texts):
            n = i + 1
            for part in word_lists(text):
                lists.append(part)
                of.append(i)
                words += len(part)
                if words >= GROUP:
                    yield from resolved(False)
                    lists, of, words = [], [], 0
        yield from resolved(True)

    def encode(self, text: bytes) -> np.ndarray:
        return next(self.encode_many([text]))


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks that a worker process runs, so words are learned once a process."""
    return Encoder(path)


class Writer:
    def __init__(self, folder: str, vocabulary: int, part: int):
        self.width, self.vocabulary = width_of(vocabulary), vocabulary
        self.out, self.uri = files.create(folder, f"part-{part:06d}-{{}}.tok")
        self.out.write(MAGIC)
        self.at, self.waiting, self.held = len(MAGIC), [], 0
        self.blocks, self.ids, self.ends, self.total = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.ids.append(doc_id)
        self.ends.append(self.total)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= RUN * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            self.blocks.append(self.at)
            data = pack(ids[a : min(whole, a + BLOCK)], self.width)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        head = {"vocabulary": self.vocabulary, "width": self.width, "block": BLOCK, "ids": self.total, "documents": len(self.ids), "blocks": len(self.blocks), "nulls": [i for i, x in enumerate(self.ids) if x is None]}
        text = json.dumps(head).encode()
        arrays = [np.array([x or 0 for x in self.ids], "<i8"), np.array(self.ends, "<i8"), np.array(self.blocks, "<i8")]
        self.out.write(struct.pack("<q", len(text)) + text + b"".join(a.tobytes() for a in arrays) + struct.pack("<q", self.at))
        self.out.close()
        return self.at


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.file = files.open_input(uri)
        size = self.file.size()
        (foot,) = struct.unpack("<q", self.file.read_at(8, size - 8))
        data = bytes(self.file.read_at(size - 8 - foot, foot))
        (n,) = struct.unpack_from("<q", data)
        self.head = json.loads(data[8 : 8 + n])
        docs, blocks = self.head["documents"], self.head["blocks"]
        self.doc_ids, self.ends = np.frombuffer(data, "<i8", docs, 8 + n), np.frombuffer(data, "<i8", docs, 8 + n + 8 * docs)
        self.offsets = np.append(np.frombuffer(data, "<i8", blocks, 8 + n + 16 * docs), foot)
        self.nulls = set(self.head["nulls"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        block, width, total = self.head["block"], self.head["width"], self.head["ids"]
        first, last = start // block, (stop - 1) // block
        data = bytes(self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first])))
        base, parts = int(self.offsets[first]), []
        for b in range(first, last + 1):
            n = min(block, total - b * block)
            parts.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], n, width))
        return np.concatenate(parts)[start - first * block : stop - first * block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start in the file and ids of each document, reading runs of blocks."""
        step, at, have = RUN * self.head["block"], 0, np.empty(0, np.uint32)
        read = 0
        for i, end in enumerate(self.ends.tolist()):
            if read < end:
                upto = min(self.head["ids"], max(end, read + step))
                have = np.concatenate([have[at - (read - have.size) :], self.ids(read, upto)])
                read = upto
            first = read - have.size
            yield None if i in self.nulls else int(self.doc_ids[i]), at, have[at - first : end - first]
            at = end


def _write(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, part = None, None, TaskContext.get().partitionId()
        for batch in batches:
            if out is None and batch.num_rows:
                encoder = encoder_of(tokenizer)
                out = Writer(folder, encoder.vocabulary, part)
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(texts) if out else (), strict=True):
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": out.uri, "documents": len(out.ids), "ids": out.total, "bytes": size}])

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)

    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for doc_id, start, ids in Reader(uri).documents():
                rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 10_000:
                    yield told(rows)
                    rows = []
            if rows:
                yield told(rows)


def write(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns the manifest (part, uri, documents, ids, bytes), files in order of part."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    told = ordered.mapInArrow(_write(scratch.path("tokens"), tokenizer, end_id), "part bigint, uri string, documents bigint, ids bigint, bytes bigint")
    with batches_of(docs.sparkSession, BATCH):
        return scratch.write("manifest", told)


def read(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files of a manifest."""
    # one row a file, so the running total is over few rows
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("base"))
    # a task a file: a number given by the caller isn't coalesced, however short the rows are
    return based.repartition(max(1, manifest.count())).mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and reads them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = write(docs, scratch, tokenizer, end_id, id_col, text_col)
    scratch.settle()
    return read(manifest)
