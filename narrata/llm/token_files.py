"""Token ids as Arrow files of equal-length sequences.

A file holds batches of two fixed-size-list columns, ``input_ids`` and
``mask``; sequence ``i`` lies at a known place, so a reader maps the file and
takes any sequence without copying.  Beside it lies a file of the documents:
where each begins among the file's ids, and how many it has.  Each file's
last sequence is padded with 0 under a false mask.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm import words
from narrata.llm.scratch import cut, new_path, uri

SEQUENCE = 2048
BATCH = 64
#: A new file begins with the first document after so many ids.
FILE_IDS = 1 << 24
#: Entries of a worker's table of encoded pieces, each of fewer than 64 characters: 100 to 180 MB.  It is emptied when full.
KNOWN = 500_000
#: Most tasks that read files back.
READERS = 10_000

# White space besides space and newline, and spaces before which the usual byte-level BPE does not cut.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
UNSAFE = re.compile(r"\s (?:\s|\Z)")

_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The worker's tokenizer and its table of encoded pieces."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path), {}
    return _TOKENIZERS[path]


def cut_text(text: str) -> list[str]:
    """Pieces of a text whose ids, put together, are those of the text.

    The usual byte-level BPE cuts before every space and around every newline
    that has no white space beside it.  Elsewhere it still cuts before a
    space, unless that has white space on both sides or ends the text after
    some; a text with such a one stays whole.
    """
    if "\0" in text:
        return [text]
    if not any(c in text for c in OTHER_SPACES):
        pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if " " not in pieces and "" not in pieces[1:-1]:
            return pieces
    return [text] if UNSAFE.search(text) else text.replace(" ", "\0 ").split("\0")


def encode_all(texts: list[str], path: str, end_id: int, kind: str) -> list[bytes]:
    """Ids of each whole text, with ``end_id`` behind, as bytes of type ``kind``.

    A piece is encoded once per worker, and once for all commas and full
    stops behind it, which are tokens of their own after a letter.
    """
    tokenizer, known = _tokenizer(path)
    code = np.dtype(kind).char
    pack = lambda ids: array(code, ids).tobytes()
    marks = {m: pack(tokenizer.encode(m, add_special_tokens=False).ids) for m in ",."}
    pieces = [cut_text(t) for t in texts]
    if len(known) > KNOWN:
        known.clear()
    if not words.KEPT:
        words.KEPT.append(known.clear)
    fresh = set().union(*pieces).difference(known)
    marked = {p for p in fresh if len(p) > 1 and p[-1] in marks and p[-2].isalpha()}
    need = list((fresh - marked) | {p[:-1] for p in marked}.difference(known))
    long = {}
    for piece, encoded in zip(need, tokenizer.encode_batch_fast(need, add_special_tokens=False), strict=True):
        (known if len(piece) < 64 else long)[piece] = pack(encoded.ids)
    for p in marked:
        (known if len(p) < 64 else long)[p] = (known.get(p[:-1]) or long[p[:-1]]) + marks[p[-1]]
    end, get = pack([end_id]), known.get
    return [b"".join([c if (c := get(p)) is not None else long[p] for p in ps]) + end for ps in pieces]


class _Writer:
    """One file of sequences and its file of documents.

    Both are written under another name and renamed when complete, so a task
    that is run again, or twice at once, leaves whole files of equal content.
    """

    def __init__(self, folder: str, name: str, kind: str, length: int) -> None:
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.length, self.kind = length, kind
        self.final, self.attempt = f"{root}/{name}", f"{root}/_{name}-{uuid.uuid4().hex}"
        ids = pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)
        self.schema = pa.schema([("input_ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.files.open_output_stream(f"{self.attempt}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes, self.ids = 0, 0
        self.docs: list[tuple[object, int, int]] = []
        self.width = np.dtype(kind).itemsize

    def add(self, doc_id: object, code: bytes) -> None:
        n = len(code) // self.width
        self.docs.append((doc_id, self.ids, n))
        self.ids += n
        self.waiting.append(code)
        self.bytes += len(code)
        if self.bytes >= BATCH * self.length * self.width:
            self._write(False)

    def _write(self, last: bool) -> None:
        """Whole batches of what waits; at the end the rest, its last sequence padded."""
        flat, size = np.frombuffer(b"".join(self.waiting), self.kind), BATCH * self.length
        full = len(flat) // size * size
        for a in range(0, full, size):
            self._batch(flat[a : a + size], np.ones(size, bool))
        rest = flat[full:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._batch(padded, np.arange(len(padded)) < len(rest))
        self.waiting, self.bytes = [rest.tobytes()], len(rest) * self.width

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self, id_type: pa.DataType) -> tuple[str, int, int]:
        self._write(True)
        self.out.close()
        self.sink.close()
        doc_ids, starts, counts = zip(*self.docs, strict=True)
        index = pa.table({"doc_id": pa.array(doc_ids, id_type), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with self.files.open_output_stream(f"{self.attempt}.docs.arrow") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        for end in (".docs.arrow", ".arrow"):
            self.files.move(self.attempt + end, self.final + end)
        return self.final.rsplit("/", 1)[1], len(self.docs), self.ids


def _open(folder: str, name: str):
    """A reader of an Arrow file: mapped where the folder is a local one."""
    files, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path))


def sequence(folder: str, name: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``i`` of a file and its mask; of a mapped file the ids are a view."""
    reader = _open(folder, f"{name}.arrow")
    # All batches but the last have equal size, so the place is a division.
    b, i = divmod(i, reader.get_batch(0).num_rows)
    batch = reader.get_batch(b)
    length = batch.schema.field("input_ids").type.list_size
    ids = batch.column(0).values.to_numpy(zero_copy_only=True)[i * length : (i + 1) * length]
    return ids, batch.column(1).values.to_numpy(zero_copy_only=False)[i * length : (i + 1) * length]


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = SEQUENCE, kind: str = "uint16") -> DataFrame:
    """Encode all texts and write them in ascending order of the key.

    Returns the written files in order: part, n_file, name, n_docs, n_ids.
    ``folder`` is a URI that every executor can write to.

    Edge cases: a null text is encoded as the empty one, which has the end id
    alone; a null key sorts first; rows of equal keys are in the order of
    their texts' hashes, so repeated rows are written as often as they occur;
    a long text may make its file larger but is never cut; an empty table
    writes no file.  Other columns are not written.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), hashed).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), hashed)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, done, id_type = TaskContext.get().partitionId(), None, [], pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                for doc_id, code in zip(some.column(0).to_pylist(), encode_all(some.column(1).to_pylist(), tokenizer, end_id, kind), strict=True):
                    if writer is not None and writer.ids >= FILE_IDS:
                        done.append(writer.close(id_type))
                        writer = None
                    if writer is None:
                        writer = _Writer(folder, f"part-{part:06d}-{len(done):04d}", kind, length)
                    writer.add(doc_id, code)
        if writer is not None:
            done.append(writer.close(id_type))
        names, n_docs, n_ids = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())],
            names=["part", "n_file", "name", "n_docs", "n_ids"],
        )

    return cut(placed.mapInArrow(job, "part long, n_file long, name string, n_docs long, n_ids long"), "token-files")


def read_index(files: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Read all documents back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; the window that adds
    them up sees one row per file.
    """
    before = F.sum("n_ids").over(Window.orderBy("part", "n_file").rowsBetween(Window.unboundedPreceding, -1))
    # As many partitions as files, by number: adaptive execution would put all of these few short rows into one task.
    placed = files.withColumn("before", F.coalesce(before, F.lit(0))).select("name", "before").repartition(max(1, min(READERS, files.count())), F.col("name"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, data = _open(folder, f"{name}.docs.arrow").read_all(), _open(folder, f"{name}.arrow")
                sums = _checksums(data, index.column("n_tokens").to_numpy())
                starts = index.column("start").to_numpy() + offset
                ids = index.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, pa.array(starts), index.column("n_tokens").combine_chunks(), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(job, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _checksums(data: pa.ipc.RecordBatchFileReader, counts: np.ndarray) -> list[int]:
    """Checksum of each document's ids, batch after batch."""
    sums, at, left, crc = [], 0, int(counts[0]), 0
    for b in range(data.num_record_batches):
        batch = data.get_batch(b)
        mask = batch.column(1).values.to_numpy(zero_copy_only=False)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[mask].astype("<u4")
        a = 0
        while a < len(ids):
            n = min(left, len(ids) - a)
            crc = zlib.crc32(ids[a : a + n].data, crc)
            a, left = a + n, left - n
            if left == 0:
                sums.append(crc)
                at, crc = at + 1, 0
                left = int(counts[at]) if at < len(counts) else 0
    if len(sums) != len(counts):
        raise ValueError("the sequences do not hold the documents that the index lists")
    return sums


def tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` into a new folder of the shared one and read them back."""
    folder = uri(docs.sparkSession, new_path(docs.sparkSession, "tokens"))
    files = write(docs, folder, tokenizer, key, text)
    return read_index(files, folder, dict(docs.dtypes)[key])
