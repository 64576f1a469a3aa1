"""Token ids as Arrow files of equal-length sequences.

Documents are dealt out and sorted by id; each task writes the ids of its range, one
document after the other, as fixed-size lists beside a mask of what is not filling,
in batches of the Arrow file format: uncompressed, so that a reader maps the file and
any sequence is a view of it. A second file holds the documents' places. A manifest,
written last, lists the files in order; files that it doesn't name (of tasks that
were run twice) don't count.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewright.llm.common import cut, partitions, scratch_dir, tasks_for
from tapewright.llm.tokens import default_path, word_encoder

LENGTH = 2048
END = 2
#: Sequences of a batch.
BATCH = 256
#: Documents of a file's index that are held before they are written.
INDEXED = 8192
MANIFEST = pa.schema([("file", pa.string()), ("first_sequence", pa.int64()), ("n_sequences", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def opened(path: str) -> pa.ipc.RecordBatchFileReader:
    """A file to read: mapped where it is local."""
    system, at = located(path)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at))


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceFile:
    """Writes documents' ids to one file, and their places to another."""

    def __init__(self, folder: str, length: int, wide: bool, id_type: pa.DataType):
        self.length, self.kind, self.schema = length, np.uint32 if wide else np.uint16, sequence_schema(length, wide)
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_ids", pa.int64())])
        self.name = f"part-{uuid.uuid4().hex}"
        self.system, at = located(folder)
        self.system.create_dir(at, recursive=True)
        self.outs = [self.system.open_output_stream(f"{at}/{self.name}{end}") for end in (".arrow", ".docs.arrow")]
        self.ids = pa.ipc.new_file(self.outs[0], self.schema)
        self.index = pa.ipc.new_file(self.outs[1], self.index_schema)
        self.held, self.n_held, self.places = [], 0, []
        self.n_ids = self.n_docs = self.n_sequences = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.places.append((doc_id, self.n_ids, len(ids)))
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += 1
        size = self.length * BATCH
        if self.n_held >= size:
            self.write(self.n_held - self.n_held % size)  # all batches but the last are whole
        if len(self.places) == INDEXED:
            self.write_index()

    def write(self, n: int) -> None:
        """The first n held ids, filled up to whole sequences."""
        every = np.concatenate(self.held)
        rest, every = every[n:], every[:n]
        size = self.length * BATCH
        for lo in range(0, n, size):
            part = every[lo : lo + size]
            full = np.zeros(-(-len(part) // self.length) * self.length, self.kind)
            full[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, np.arange(len(full)) < len(part))]
            self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            self.n_sequences += len(full) // self.length
        self.held, self.n_held = [rest], len(rest)

    def write_index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.places, strict=True), self.index_schema, strict=True)], schema=self.index_schema))
        self.places = []

    def close(self) -> None:
        if self.n_held:
            self.write(self.n_held)
        if self.places:
            self.write_index()
        for x in (self.ids, self.index, *self.outs):
            x.close()


def write_files(folder: str, tokenizer: str, length: int, end: int):
    """Sorted (id, mark, text) batches -> the file that they make, as one row with its first (id, mark)."""

    def go(batches):
        encode, out, first = word_encoder(tokenizer), None, None
        wide = max(encode.tokenizer.get_vocab_size(), end + 1) > 1 << 16
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, first = SequenceFile(folder, length, wide, batch.column("id").type), batch.slice(0, 1).select(["id", "mark"])
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out.add(doc, np.append(encode.encode(text or ""), np.uint32(end)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array([out.name]), *[pa.array([x], pa.int64()) for x in (out.n_sequences, out.n_ids, out.n_docs)]], ["id", "mark", "file", "n_sequences", "n_ids", "n_docs"])

    return go


def write_sequences(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> str:
    """Writes the ids of all texts, in order of id, as sequences of ``length``; returns the folder.

    folder: a path or URI that all executors reach, by default a new one in the shared
    folder. tokenizer: the path of the vocabulary, which every executor must have. The
    id ``end`` ends each document. Each file's last sequence is filled up with zeros,
    where its mask is false.

    Cases: a null or empty text is the end id alone; null ids come first; rows with one
    id stand in the order of a hash of their text; an empty table gives a manifest
    without files; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/sequences-{uuid.uuid4().hex}"
    own = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(own).alias("mark"), own.alias("text"))
    tasks = max(partitions(spark), tasks_for(docs.count()))
    rows = rows.repartitionByRange(tasks, "id", "mark").sortWithinPartitions("id", "mark")
    made = StructType([rows.schema["id"]]).add("mark", "long").add("file", "string").add("n_sequences", "long").add("n_ids", "long").add("n_docs", "long")
    files = cut(rows.mapInArrow(write_files(folder, tokenizer or default_path("word_bpe_49k.json"), length, end), made), "sequence-files")
    listed = files.orderBy("id", "mark").drop("id", "mark").collect()  # one row a task
    columns = {c: [r[c] for r in listed] for c in ("file", "n_sequences", "n_ids", "n_docs")}
    for total, first in (("n_sequences", "first_sequence"), ("n_ids", "first_id")):
        columns[first] = np.append(0, np.cumsum(np.array(columns[total], np.int64)))[:-1]
    system, at = located(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/manifest.arrow.part") as out, pa.ipc.new_file(out, MANIFEST) as writer:
        writer.write_table(pa.table([pa.array(columns[f.name], f.type) for f in MANIFEST], schema=MANIFEST))
    system.move(f"{at}/manifest.arrow.part", f"{at}/manifest.arrow")
    return folder


def manifest(folder: str) -> pa.Table:
    return opened(f"{folder}/manifest.arrow").read_all()


def read_files(folder: str):
    """(file) batches -> a row for each document of these files, from the ids that they hold."""

    def go(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                ids, index = opened(f"{folder}/{name}.arrow"), opened(f"{folder}/{name}.docs.arrow")
                places = index.read_all()
                starts = places.column("start").to_numpy()
                ends = starts + places.column("n_ids").to_numpy()
                crc, got, at, k = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0, 0
                for b in range(ids.num_record_batches):
                    part = ids.get_batch(b)
                    real = part.column("mask").flatten().true_count
                    values = part.column("ids").flatten().to_numpy()[:real]
                    while k < len(starts) and starts[k] < at + real:
                        lo, hi = max(starts[k], at), min(ends[k], at + real)
                        crc[k] = zlib.crc32(values[lo - at : hi - at].astype("<u4").tobytes(), int(crc[k]))
                        got[k] += hi - lo
                        if ends[k] > at + real:
                            break
                        k += 1
                    at += real
                n = len(starts)
                for lo in range(0, n, 10_000):
                    rows = slice(lo, min(lo + 10_000, n))
                    own = places.slice(lo, rows.stop - lo)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * own.num_rows), own.column("doc_id").combine_chunks(), own.column("start").combine_chunks(), pa.array(got[rows]), pa.array(crc[rows])], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    return go


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a folder, as they are read.

    start: the ids of all documents before it; ids_crc32: of its ids as little-endian
    unsigned 32-bit integers. Raises an error if a file doesn't hold what the manifest says.
    """
    files = manifest(folder)
    names = files.column("file").to_pylist()
    kind = opened(f"{folder}/{names[0]}.docs.arrow").schema.field("doc_id").type if names else pa.int64()
    from pyspark.sql.pandas.types import from_arrow_type

    made = StructType.fromDDL("file string").add("doc_id", from_arrow_type(kind)).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    listed = spark.createDataFrame(list(zip(names, files.column("first_id").to_pylist(), files.column("n_ids").to_pylist(), strict=True)), "file string, first_id long, n_ids long")
    rows = cut(listed.select("file").repartition(max(1, len(names))).mapInArrow(read_files(folder), made), "sequence-docs")
    held = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a file
    if wrong := [n for n, size in zip(names, files.column("n_ids").to_pylist(), strict=True) if held.get(n) != size]:
        raise ValueError(f"{len(wrong)} files don't hold what the manifest says, the first of them {wrong[0]}")
    return rows.join(listed, "file").select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


class Sequences:
    """Random access to all sequences of a folder: item k is (ids, mask), views of the file."""

    def __init__(self, folder: str):
        self.folder, files = folder, manifest(folder)
        self.names, self.first = files.column("file").to_pylist(), files.column("first_sequence").to_pylist()
        self.n = self.first[-1] + files.column("n_sequences")[-1].as_py() if self.names else 0
        self.readers: dict[int, pa.ipc.RecordBatchFileReader] = {}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= k < self.n:
            raise IndexError(k)
        f = bisect.bisect_right(self.first, k) - 1
        if f not in self.readers:
            self.readers[f] = opened(f"{self.folder}/{self.names[f]}.arrow")
        batch, row = divmod(k - self.first[f], BATCH)
        part = self.readers[f].get_batch(batch)
        return part.column("ids")[row].values.to_numpy(), part.column("mask")[row].values


__all__ = ["Sequences", "manifest", "read_sequences", "write_sequences"]
