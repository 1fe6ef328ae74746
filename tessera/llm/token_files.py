"""Token-id files with Elias-Fano document boundaries.

One file holds consecutive documents in ascending id order:

    "TEF1" | ids, little-endian unsigned 16 or 32 bit | boundaries | doc ids | footer | footer length (u32) | "TEF1"

The ids of all documents lie end to end. Boundaries (the running end of each document, counted in
ids) and document ids (less the smallest) are two non-decreasing sequences, each as Elias-Fano:
the low bits packed, the high bits in unary, about 2 + log2(u/n) bits a value. ``EliasFano.select``
finds the i-th value from the position of the i-th one bit, with a sample of every 256th position.
The footer is JSON and says sizes, widths and the number of leading documents without an id.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import order_by_id, partitions, remember, scratch_path, strings, text_batches
from tessera.llm.pieces import PieceEncoder

MAGIC = b"TEF1"
SAMPLE = 256
#: Documents read back at a time.
READ = 10_000
#: The library's model is slow on single pieces, so more of them are remembered (about 300 MB a worker).
CHUNK_ENTRIES = 900_000
PIECE_ENTRIES = 500_000


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low: int, low_bytes: bytes, high_bytes: bytes, samples: np.ndarray):
        self.n, self.low, self.low_bytes, self.high_bytes, self.samples = n, low, low_bytes, high_bytes, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        if np.any(v[1:] < v[:-1]):
            raise ValueError("the sequence decreases")
        low = max(0, int(int(v[-1]) // n).bit_length() - 1)
        lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low, np.packbits(lows.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint64))

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        first, last = i * self.low, (i + 1) * self.low
        window = int.from_bytes(self.low_bytes[first // 8 : (last + 7) // 8], "little")
        return (window >> (first % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value, without unpacking the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, skip = at // 8, at % 8 + 1
            word = self.high_bytes[byte] >> skip << skip
            while (c := word.bit_count()) < left:
                left -= c
                byte += 1
                word = self.high_bytes[byte]
            for _ in range(left - 1):
                word &= word - 1
            at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.low | self._low(i)

    def decode(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high_bytes, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low
        if self.low:
            bits = np.unpackbits(np.frombuffer(self.low_bytes, np.uint8), bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)
        return out

    def parts(self) -> tuple[list[int], bytes]:
        s = self.samples.astype("<u8").tobytes()
        return [self.n, self.low, len(self.low_bytes), len(self.high_bytes), len(s)], self.low_bytes + self.high_bytes + s

    @classmethod
    def read(cls, sizes: list[int], raw: bytes) -> EliasFano:
        n, low, a, b, c = sizes
        return cls(n, low, raw[:a], raw[a : a + b], np.frombuffer(raw[a + b : a + b + c], "<u8"))


class TokenFileWriter:
    """Streams documents into one file; only two integers a document stay in memory."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.ends, self.ids, self.unnamed = array("q"), array("q"), 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.stream.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.at += len(ids)
        self.ends.append(self.at)
        if doc_id is None:
            self.unnamed += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> None:
        base = self.ids[0] if self.ids else 0
        a, raw_a = EliasFano.encode(np.frombuffer(self.ends, np.int64)).parts()
        b, raw_b = EliasFano.encode(np.frombuffer(self.ids, np.int64) - base).parts()
        foot = json.dumps({"width": self.width, "n_ids": self.at, "bounds": a, "docs": b, "base": base, "unnamed": self.unnamed}).encode()
        self.stream.write(raw_a + raw_b + foot + len(foot).to_bytes(4, "little") + MAGIC)
        self.stream.close()


class TokenFile:
    """One file, read back. ``doc(i)`` gives a document by two selects; ``ends``/``doc_ids`` give all."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or raw[-4:] != MAGIC:
            raise ValueError("no token file, or one cut short")
        size = int.from_bytes(raw[-8:-4], "little")
        foot = json.loads(raw[-8 - size : -8])
        self.n_ids, self.base, self.unnamed = foot["n_ids"], foot["base"], foot["unnamed"]
        at = 4 + self.n_ids * foot["width"]
        self.ids = np.frombuffer(raw, "<u2" if foot["width"] == 2 else "<u4", self.n_ids, 4)
        self.bounds = EliasFano.read(foot["bounds"], raw[at : at + sum(foot["bounds"][2:])])
        at += sum(foot["bounds"][2:])
        self.docs = EliasFano.read(foot["docs"], raw[at : at + sum(foot["docs"][2:])])

    def __len__(self) -> int:
        return self.bounds.n

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.bounds.select(i)]

    def start(self, i: int) -> int:
        """Ids before document ``i``."""
        return self.bounds.select(i - 1) if i else 0

    def doc_id(self, i: int) -> int | None:
        return self.docs.select(i - self.unnamed) + self.base if i >= self.unnamed else None

    def ends(self) -> np.ndarray:
        return self.bounds.decode()

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self.docs.decode() + self.base).tolist()


class _Unlike(Exception):
    """A piece with a character that the library's split takes for another class."""


class LibraryEncoder:
    """Ids from the tokenizers library, asked once per distinct piece of the vocabulary's own split.

    The byte-level pre-tokenizer cuts a text into pieces that never merge across their edges, so a
    text's ids are its pieces' ids end to end; the library's model gets each piece in its byte
    alphabet. Texts that hold an added token's string, or a character which the library's split
    takes for another class than ``pattern`` does, are encoded by the library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        if not isinstance(tokenizer.pre_tokenizer, ByteLevel) or tokenizer.normalizer is not None:
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.model, self.whole = tokenizer.model, tokenizer
        self.library_split, self.split = tokenizer.pre_tokenizer.pre_tokenize_str, regex.compile(pattern).findall
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.agreed, self.other = set(map(chr, range(128))), set()
        self.size = tokenizer.get_vocab_size()
        self.dtype, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        ascii_form = level.pre_tokenize_str("".join(map(chr, range(128))))[0][0]
        self.table = dict(enumerate(ascii_form))
        # the bytes of other characters: continuation bytes from one character each, lead bytes likewise
        for code in range(128, 0x110000, 64):
            if not 0xD800 <= code < 0xE000:
                self._learn(level, chr(code))
        for code in range(128, 192):
            self._learn(level, chr(code))
        self.encode_text = PieceEncoder(pattern, self._piece, CHUNK_ENTRIES, PIECE_ENTRIES).encode

    def _learn(self, level, char: str) -> None:
        for byte, mark in zip(char.encode("utf-8"), level.pre_tokenize_str(char)[0][0], strict=True):
            self.table[byte] = mark

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and not self._ordinary(piece):
            raise _Unlike
        marked = piece.encode("utf-8").decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(marked)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _differs(self, char: str) -> bool:
        """Whether the two splits put ``char`` into different classes (letter, number, space, other)."""
        probe = f"a{char}1!{char}!"
        at, cuts = 0, []
        for piece in self.split(probe):
            cuts.append((at, at + len(piece)))
            at += len(piece)
        return cuts != [span for _, span in self.library_split(probe)]

    def _ordinary(self, piece: str) -> bool:
        """Whether the library splits the characters of ``piece`` as ``pattern`` does."""
        chars = set(piece) - self.agreed
        new = chars - self.other
        differ = {c for c in new if self._differs(c)}
        self.other |= differ
        self.agreed |= new - differ
        return chars.isdisjoint(self.other)

    def _text(self, text: str) -> bytes:
        """Ids as bytes; a piece is looked at once, as only those of ordinary characters are remembered."""
        if not any(token in text for token in self.added):
            try:
                return self.encode_text(text)
            except _Unlike:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str], end_id: int | None) -> list[np.ndarray]:
        tail = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        return [np.frombuffer(self._text(t) + tail, self.dtype) for t in texts]


@lru_cache(maxsize=2)
def library(path: str, pattern: str) -> LibraryEncoder:
    remember("token_files", library.cache_clear)
    return LibraryEncoder(path, pattern)


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write token files in ascending doc_id order; returns the file list.

    Rows are dealt into doc_id ranges (one shuffle of id and text), and each task streams one file
    ``part-NNNNNN.tef`` to ``folder``, a place all executors share: it is written under the
    attempt's name and then moved, so a task that runs again replaces its file with the same bytes.
    Returns part int, path string, n_docs long, n_ids long. Equal ids keep the order of their
    texts; null ids come first; null and empty texts hold the end id alone; an empty table gives
    no file.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = order_by_id(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), "doc_id", n)
    rows = rows.sortWithinPartitions("doc_id", "text").select("_bucket", "doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        out = None
        for part in text_batches(batches, owner="token_files"):
            coder = library(tokenizer_path, pattern)
            if out is None:
                bucket = part.column(0)[0].as_py()
                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                final = f"{root}/part-{bucket:06d}.tef"
                draft = f"{root}/.draft-{bucket:06d}-{TaskContext.get().taskAttemptId()}"
                out = TokenFileWriter(fs.open_output_stream(draft), 2 if coder.size <= 1 << 16 else 4)
            for i, ids in zip(part.column(1).to_pylist(), coder.encode(strings(part.column(2)), end_id), strict=True):
                out.add(i, ids)
        if out is not None:
            out.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([final]), pa.array([len(out.ends)], pa.int64()), pa.array([out.at], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    return rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (see the query op9).

    ``files`` is a list as :func:`write_token_files` returns; starts come from a running sum over
    files (one row each) plus the file's select structures, which give each document's place and id.
    """
    spark = files.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("first", F.coalesce(before, F.lit(0)))
    listed = listed.repartition(partitions(spark), "part")

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for part in batches:
            for row in part.to_pylist():
                with fs.open_input_stream(row["path"]) as f:
                    file = TokenFile(f.read())
                for low in range(0, len(file), READ):
                    some = range(low, min(low + READ, len(file)))
                    starts = [file.start(i) for i in some]
                    ids = [file.doc(i) for i in some]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array([file.doc_id(i) for i in some], pa.int64()), pa.array([x + row["first"] for x in starts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system; one without a scheme is on Spark's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def token_files(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write token files for ``docs`` and return what they say when read back."""
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    uri = qualified(spark, folder)
    listing = write_token_files(docs, tokenizer_path, pattern, uri, end_id)
    path = scratch_path(spark, "token-file-list")
    listing.write.parquet(path)
    return read_token_files(spark.read.schema(listing.schema).parquet(path), uri)
