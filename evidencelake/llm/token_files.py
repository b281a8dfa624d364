"""Operator 8: token ids in Arrow files of equal-length sequences.

A corpus becomes one pair of files per range of document ids:

``seq-NNNNNN.arrow``
    Arrow file format, columns ``input_ids: fixed_size_list<uint16|uint32>[L]`` and
    ``mask: fixed_size_list<bool>[L]``. Every record batch but the last has ``ROWS`` sequences,
    so sequence ``k`` is row ``k % ROWS`` of batch ``k // ROWS``: a memory map and two
    offsets, no copy. The tail of the last sequence is padded with 0 and masked False.
``doc-NNNNNN.arrow``
    ``doc_id, start, n_tokens`` of every document in the file, ``start`` within the file.

Tasks write to a name of their own and rename at the end, so a repeated task leaves one file.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencelake.llm.code_points import newer
from evidencelake.llm.wordcache import TwoGenerations
from evidencelake.scratch import new_path

SEQUENCE_LENGTH = 2048
ROWS = 64
#: Bytes of each generation of cached pieces.
CACHED_BYTES = 96 << 20
#: The piece pattern of this public vocabulary (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space but for space and line feed, on which regular expression engines may differ, and the mark of the fast split.
ODD_SPACE = frozenset(chr(c) for c in (0, *range(9, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if c != 10)


def byte_alphabet() -> str:
    """The printable character for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class ByteLevelEncoder:
    """Ids of whole texts as the tokenizers library gives them, a piece at a time through a cache.

    The library's model sees each distinct piece once while it stays cached. Plain prose is cut
    at spaces, line feeds, commas and full stops, which are piece boundaries there; any other
    text is cut by the pattern; a text with a special token or a character of a newer Unicode goes to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.alphabet = byte_alphabet()
        self.cache = TwoGenerations(CACHED_BYTES)

    def _cut(self, text: str) -> list[str] | None:
        seen = set(text)
        if not ODD_SPACE.isdisjoint(seen) or not text.isascii() and not newer().isdisjoint(seen) or any(t in text for t in self.special):
            return None
        ends = [c for c in seen if not c.isalnum()]
        if text[:1] in " \n" or text[-1:] in " \n" or any(c + d in text for c in ends for d in ",.") or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return PIECES.findall(text)
        return text.replace(",", "\0,").replace(".", "\0.").replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _piece(self, piece: str) -> bytes:
        parts = [piece] if piece.lstrip(" ").isalpha() else PIECES.findall(piece)
        names = (p.encode("utf-8").decode("latin-1").translate(self.alphabet) for p in parts)
        return np.array([t.id for n in names for t in self.model.tokenize(n)], self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text; a null text counts as empty."""
        cut = [self._cut(t) if t else [] for t in texts]
        for w in self.cache.missing(itertools.chain.from_iterable(c for c in cut if c)):
            self.cache.put(w, self._piece(w))
        get = self.cache.young
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() if c is None else b"".join([get[w] for w in c])
            for t, c in zip(texts, cut)
        ]


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(tokenizer_file: str) -> ByteLevelEncoder:
    """One encoder and cache for each worker process."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = ByteLevelEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


class _Writer:
    """The two files of one partition, under temporary names until ``close``."""

    def __init__(self, uri: str, part: int, dtype: np.dtype, length: int):
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root)
        self.names = [f"{self.root}/{x}-{part:06d}.arrow" for x in ("seq", "doc")]
        self.temporary = [f"{n}.{uuid.uuid4().hex}" for n in self.names]
        self.dtype, self.length, self.rest, self.total = dtype, length, np.empty(0, dtype), 0
        lists = [pa.list_(pa.from_numpy_dtype(dtype), length), pa.list_(pa.bool_(), length)]
        self.schema = pa.schema([("input_ids", lists[0]), ("mask", lists[1])])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.outs = [self.fs.open_output_stream(t) for t in self.temporary]
        self.files = [pa.ipc.new_file(o, s) for o, s in zip(self.outs, (self.schema, self.index))]

    def add(self, doc_ids: list[int], ids: list[bytes]) -> None:
        counts = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        starts = self.total + np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.files[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index))
        self.total += int(counts.sum())
        flat = np.concatenate((self.rest, np.frombuffer(b"".join(ids), self.dtype)))
        step = ROWS * self.length
        whole = len(flat) // step * step
        for a in range(0, whole, step):
            self._write(flat[a : a + step], step)
        self.rest = flat[whole:].copy()

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(flat)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(flat), mask)]
        self.files[0].write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if real := len(self.rest):
            padded = np.zeros(-(-real // self.length) * self.length, self.dtype)
            padded[:real] = self.rest
            self._write(padded, real)
        for x in (*self.files, *self.outs):
            x.close()
        for a, b in zip(self.temporary, self.names):
            self.fs.move(a, b)


def write_token_files(
    docs: DataFrame, uri: str, tokenizer_file: str, end_id: int | None = None, length: int = SEQUENCE_LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode ``docs`` in ascending id order into token files below ``uri``; returns the manifest.

    One range shuffle of the texts puts ids in order; each task then encodes its range as a
    stream and writes one pair of files. The manifest has a row for each pair: ``part,
    n_docs, n_tokens, start`` (ids before the file). Null and empty texts give the end id alone
    (nothing without ``end_id``); repeated ids keep all their rows; extra columns are not read;
    an empty table gives no files. ``uri`` must be a folder that all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n = TaskContext.get().partitionId(), None, 0
        enc = encoder(tokenizer_file)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            writer = writer or _Writer(uri, part, enc.dtype, length)
            writer.add(batch.column(0).to_pylist(), [x + end for x in enc.encode(batch.column(1).to_pylist())])
            n += batch.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": n, "n_tokens": writer.total}])

    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = sorted(ordered.mapInArrow(write, "part long, n_docs long, n_tokens long").collect())  # one row a file
    manifest, start = [], 0
    for r in rows:
        manifest.append((r.part, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(manifest, "part long, n_docs long, n_tokens long, start long")


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """A sequence file by memory map (local paths); ``sequence`` reads from it without copying."""
    return pa.ipc.open_file(pa.memory_map(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.Array]:
    """Ids (a view of the mapped file) and mask of sequence ``k``."""
    batch = reader.get_batch(k // ROWS)
    length = batch.schema.field("input_ids").type.list_size
    at = k % ROWS * length
    return batch.column(0).flatten()[at : at + length].to_numpy(zero_copy_only=True), batch.column(1).flatten()[at : at + length]


def read_token_files(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start`` (in the corpus)``, n_tokens, ids_crc32``.

    The checksum is that of the document's ids as little-endian unsigned 32-bit integers.
    One task streams one file; a document may span any number of sequences.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = pa.ipc.open_file(files.open_input_file(f"{root}/doc-{part:06d}.arrow"))
                seq = pa.ipc.open_file(files.open_input_file(f"{root}/seq-{part:06d}.arrow"))
                stream = (seq.get_batch(i).column(0).flatten().to_numpy() for i in range(seq.num_record_batches))
                buffer = np.empty(0, np.uint16)
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    sums = []
                    for n in docs.column(2).to_pylist():
                        crc = 0
                        while n:
                            if not len(buffer):
                                buffer = next(stream)
                            take = buffer[:n]
                            crc, n, buffer = zlib.crc32(take.astype("<u4").tobytes(), crc), n - len(take), buffer[len(take) :]
                        sums.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + before)
                    yield pa.record_batch([docs.column(0), starts, docs.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("part", "start").repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table through the files and back."""
    import public_tokenizers

    uri = new_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, uri, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, uri, manifest)
