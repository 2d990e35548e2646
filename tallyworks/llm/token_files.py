"""Token ids as Arrow stream files of fixed-size lists: equal-length sequences and masks, read without copies.

Ids take two bytes where the vocabulary allows it, masks one bit an id.

Documents are dealt out by ranges of doc_id, one file a range. In a file the ids of its documents, each followed by the end
id, run on in doc_id order and are cut into rows of `seq_len` ids; the last row is filled up with zeros that its mask marks.
All record batches but the last have the same number of rows, so that batch i begins at data_offset + i * batch_bytes and
any row is found without reading what stands before it. An index file (same format) has doc_id, start and n_tokens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import gathered, id_text, materialize, new_path, once, slices
from .pretoken import SPLIT, PieceMemo

BATCH_ROWS = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "file_no int, path string, width long, n_docs long, n_tokens long, n_rows long, data_offset long, batch_bytes long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def sequence_schema(seq_len: int, width: int) -> pa.Schema:
    """ids of `width` bytes, and masks of one bit an id, packed from the left."""
    kind = {2: pa.uint16(), 4: pa.uint32()}[width]
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), seq_len)), ("mask", pa.list_(pa.field("item", pa.uint8(), False), seq_len // 8))])


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def id_width(n_ids: int) -> int:
    return 2 if n_ids <= 1 << 16 else 4


def splits_by(stated: dict, pattern: str) -> bool:
    """Whether a tokenizer file says byte-level BPE over the matches of the public split pattern, which `pattern` is, and no more."""
    before, model = stated.get("pre_tokenizer") or {}, stated["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    extras = (stated.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"))
    return plain and pattern == SPLIT and model.get("type") == "BPE" and not any(extras)


class LibraryEncoder:
    """The tokenizers library's byte-level BPE model, each distinct pre-token encoded once while it is remembered.

    Ids are those of Tokenizer.encode(text, add_special_tokens=False): the string of an added token in a text is that token,
    so a text that holds one goes through that call; so do all texts where the file normalises, or splits otherwise than by `pattern`.
    """

    def __init__(self, tokenizer_json: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()  # whole texts, whatever the file says
        self.tokenizer.no_padding()
        self.by_pieces = splits_by(json.loads(tokenizer_json), pattern)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.width = id_width(self.tokenizer.get_vocab_size())
        self.memo = PieceMemo(self.encode_match, pattern, limit=450_000)

    def encode_match(self, match: str) -> bytes:
        word = match.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(word)])

    def encode(self, text: str) -> bytes:
        if not self.by_pieces or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()
        return self.memo.text(text)


class _Writer:
    """One sequence file and its index; renamed into place when whole, so a task that runs twice leaves one good file."""

    def __init__(self, folder: str, file_no: int, attempt: int, seq_len: int, width: int):
        self.fs, at = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(at)
        self.path, self.draft = f"{at}/part-{file_no:06d}", f"{at}/.draft-{file_no:06d}-{attempt}"
        self.seq_len, self.width, self.schema = seq_len, width, sequence_schema(seq_len, width)
        self.sinks = [self.fs.open_output_stream(f"{self.draft}.{kind}") for kind in ("arrows", "index")]
        self.out, self.index = pa.ipc.new_stream(self.sinks[0], self.schema), pa.ipc.new_stream(self.sinks[1], INDEX)
        self.data_offset = self.batch_bytes = self.n_tokens = self.n_docs = self.n_rows = 0
        self.held: list[bytes] = []
        self.size = 0
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids) // self.width))
        self.n_tokens += len(ids) // self.width
        self.n_docs += 1
        self.held.append(ids)
        self.size += len(ids)
        full = BATCH_ROWS * self.seq_len * self.width
        if self.size >= full:
            data = b"".join(self.held)
            whole = len(data) // full * full
            for at in range(0, whole, full):
                self._batch(np.frombuffer(data, f"<u{self.width}", full // self.width, at), full // self.width)
            self.held, self.size = [data[whole:]], len(data) - whole
        if len(self.rows) >= 65536:
            self._index()

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        batch = pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.out.write_batch(batch)
        if not self.n_rows:
            self.batch_bytes = pa.ipc.get_record_batch_size(batch)
            self.data_offset = self.sinks[0].tell() - self.batch_bytes
        self.n_rows += len(ids) // self.seq_len

    def _index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), INDEX, strict=True)], schema=INDEX))
        self.rows = []

    def close(self) -> tuple:
        if self.size:
            data = np.frombuffer(b"".join(self.held), f"<u{self.width}")
            rows = -(-len(data) // self.seq_len)
            self._batch(np.concatenate([data, np.zeros(rows * self.seq_len - len(data), data.dtype)]), len(data))
        if self.rows:
            self._index()
        for x in (self.out, self.index, *self.sinks):
            x.close()
        for kind in ("arrows", "index"):
            self.fs.move(f"{self.draft}.{kind}", f"{self.path}.{kind}")
        return self.n_docs, self.n_tokens, self.n_rows, self.data_offset, self.batch_bytes


class TokenFile:
    """Random access to a sequence file. Arrays are views of the mapped file where it is local."""

    def __init__(self, folder: str, path: str, seq_len: int, data_offset: int, batch_bytes: int, width: int):
        fs, at = pafs.FileSystem.from_uri(f"{folder}/{path}.arrows")
        self.source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.schema, self.seq_len, self.data_offset, self.batch_bytes = sequence_schema(seq_len, width), seq_len, data_offset, batch_bytes
        self.at, self.now = -1, (np.zeros(0, np.uint16), np.zeros(0, np.uint8))

    def _flat(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        if batch != self.at:
            self.source.seek(self.data_offset + batch * self.batch_bytes)
            read = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
            self.at, self.now = batch, tuple(read.column(i).flatten().to_numpy() for i in (0, 1))
        return self.now

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and packed mask of one row, both views; np.unpackbits() opens the mask."""
        ids, mask = self._flat(row // BATCH_ROWS)
        at, n = row % BATCH_ROWS, self.seq_len
        return ids[at * n : (at + 1) * n], mask[at * n // 8 : (at + 1) * n // 8]

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, in views of one batch each."""
        full = BATCH_ROWS * self.seq_len
        while n > 0:
            ids, _ = self._flat(start // full)
            piece = ids[start % full : start % full + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str | None = None, seq_len: int = 2048, end_id: int = 2, n_files: int | None = None, file_bytes: int = 256 << 20) -> tuple[DataFrame, str]:
    """Encode all texts and write them under `folder` (a URI of a shared store; default: in the shared folder).

    Returns the manifest (one row a file, with `base`, the ids in all files before it) and the folder. Null text counts as
    empty: only the end id. Rows without doc_id come first; rows with the same doc_id stand next to each other, each with
    its ids, and may run over several files; equal ones of one input partition stay in one. No documents: no files, an empty manifest. A document may be of any length and run over many rows. There are
    as many files as the texts have `file_bytes`, or as shuffles have partitions if that is more.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    key = f"library-{tokenizer_path}-{pattern}"
    if seq_len % 8:
        raise ValueError("seq_len must be a multiple of 8")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: LibraryEncoder = once(key, lambda: LibraryEncoder(vocabulary.value, pattern))
        context, writer = TaskContext.get(), None
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                writer = writer or _Writer(folder, context.partitionId(), context.taskAttemptId(), seq_len, encoder.width)
                writer.add(doc_id, encoder.encode(text or "") + end_id.to_bytes(encoder.width, "little"))
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([context.partitionId()], pa.int32()), "path": [f"part-{context.partitionId():06d}"], "width": pa.array([encoder.width], pa.int64())} | {k: pa.array([v], pa.int64()) for k, v in zip(("n_docs", "n_tokens", "n_rows", "data_offset", "batch_bytes"), done, strict=True)})

    if not n_files:
        total = id_text(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    # rows that share an id, or have none, are spread too; the same rows have the same partition again if a task is repeated
    by = [F.col("doc_id"), F.xxhash64("text"), F.col("part")]
    ranged = id_text(docs).withColumn("part", F.spark_partition_id()).repartitionByRange(n_files, *by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    manifest = materialize(ranged.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), folder


def read_documents(manifest: DataFrame, folder: str, seq_len: int = 2048) -> DataFrame:
    """Documents as they stand in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for m in batch.to_pylist():
                    data = TokenFile(folder, m["path"], seq_len, m["data_offset"], m["batch_bytes"], m["width"])
                    fs, at = pafs.FileSystem.from_uri(f"{folder}/{m['path']}.index")
                    with pa.ipc.open_stream(fs.open_input_stream(at)) as index:
                        for part in index:
                            for doc_id, start, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                                crc = 0
                                for piece in data.span(start, n):
                                    crc = zlib.crc32(piece.astype("<u4"), crc)
                                yield doc_id, m["base"] + start, n, crc

        yield from gathered(rows(), READ)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartitionByRange(n, "file_no").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
