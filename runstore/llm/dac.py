"""Token ids in directly addressable codes, written to files and read back (operator 4).

A file holds the ids of consecutive whole documents.  Each id is cut into 8-bit chunks, lowest first;
level k holds the k-th chunks of all ids that have one, in order, with a bitmap that says which of them
go on in level k + 1, and a rank directory (set bits before each block of 512).  Position i of level k is
found in level k + 1 at rank(i), so any id, or any run of ids, is read without decoding what is before.

Format of a file (little-endian): ``DAC1``, u32 levels, u64 ids, u32 documents, u32 zero; u64 ends of the documents (in
ids); for each level u64 length, then chunks, bitmap padded to 8 bytes, and u64 ranks.  Files are cells of
a Parquet table in the cluster's shared folder (part, first position in the part, ids, document ids, file), so
that writing and reading go through Spark's own storage layer and survive lost executors.

Whole texts go to the tokenizers library, which splits and merges them; a byte-level BPE file is given to it with other names for
the same symbols (``spelled``), which gives the same ids in less time.  Rows are dealt by ranges of doc_id and text hash, sorted, and encoded where they
arrive; only the count of ids in each part, one number for each partition, goes to the driver.  Defined cases: null text
counts as empty (just the end id); null doc_ids come first; rows with one doc_id are ordered by text hash and text, so that many rows of one id
are split too; repeated rows are written each; doc_ids may be of any type that Spark can sort; a very long text is encoded whole and makes a file
of its own at most; an empty table gives no files.  Files hold ids and doc_ids only: other columns, of whatever name, are left out.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runstore.llm.common import BYTE_LEVEL, new_path, quoted, with_batches
from runstore.llm.tokencount import printable_bytes

END_ID = 0
FILE_IDS = 1 << 19
BITS = 8
RANK_BLOCK = 512


def encode_ids(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A file of ids (unsigned 32-bit) of documents that end at ``ends``."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest >> BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % 8))
        per_block = np.add.reduceat(goes_on.astype("<u8"), np.arange(0, len(rest), RANK_BLOCK)) if len(rest) else np.zeros(0, "<u8")
        ranks = (np.cumsum(per_block) - per_block).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest = more[goes_on]
        if not len(rest):
            break
    return b"DAC1" + struct.pack("<IQII", len(levels), len(ids), len(ends), 0) + ends.astype("<u8").tobytes() + b"".join(levels)


class DacFile:
    """Random access to the ids of a file."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 file")
        n_levels, self.n_ids, n_docs, _ = struct.unpack_from("<IQII", data, 4)
        at = 24
        self.ends = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            size = -(-n // 64) * 8
            bitmap = np.frombuffer(data, np.uint8, size, at)
            at += size
            blocks = -(-n // RANK_BLOCK)
            ranks = np.frombuffer(data, "<u8", blocks, at)
            at += 8 * blocks
            self.levels.append((chunks, bitmap, ranks))

    def rank(self, level: int, i: int) -> int:
        """Ids of the level before position i that go on."""
        chunks, bitmap, ranks = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i // RANK_BLOCK
        piece = bitmap[block * RANK_BLOCK // 8 : i // 8 + 1].copy()
        piece[-1] &= (1 << i % 8) - 1
        return int(ranks[block]) + int(np.bitwise_count(piece).sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + BITS
        return value

    def run(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi as unsigned 32-bit integers."""
        out = np.zeros(max(0, hi - lo), "<u4")
        where = np.arange(len(out))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if lo >= hi:
                break
            out[where] |= chunks[lo:hi].astype("<u4") << np.uint32(level * BITS)
            bits = np.unpackbits(bitmap[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo]
            where = where[bits.astype(bool)]
            lo = self.rank(level, lo)
            hi = lo + len(where)
        return out

    def documents(self) -> Iterator[np.ndarray]:
        lo, ids = 0, self.run(0, self.n_ids)  # all at once: a run for each short document costs more
        for hi in self.ends.tolist():
            yield ids[lo:hi]
            lo = hi


_libraries: dict[str, object] = {}


def spelled(spec: dict) -> dict | None:
    """The tokenizer of a byte-level BPE file with its symbols spelled by bytes; None for a file of another kind.

    Ids, merges, split pattern and added tokens stay.  ASCII symbols are written as they are and other bytes as ``<0xNN>``, to which
    the library's byte fallback turns characters itself, so it need not rewrite every piece of a text in printable characters first.
    """
    model, pre, post = spec["model"], spec["pre_tokenizer"] or {}, spec["post_processor"] or {}
    byte_level = pre == pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and post.get("type", "ByteLevel") == "ByteLevel"
    settings = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or spec["normalizer"] is not None or not byte_level or any(map(model.get, settings)):
        return None
    names = {c: chr(b) if b < 128 else f"<0x{b:02X}>" for c, b in printable_bytes().items()}
    if not all(c in names for name in model["vocab"] for c in name) or not names.keys() <= model["vocab"].keys():
        return None

    def name(symbol: str) -> str:
        return "".join(map(names.__getitem__, symbol))

    vocab = {name(symbol): i for symbol, i in model["vocab"].items()}
    if len(vocab) < len(model["vocab"]):
        return None
    merges = [[name(x) for x in (pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    split = {"type": "Split", "pattern": {"Regex": BYTE_LEVEL}, "behavior": "Isolated", "invert": False}
    return spec | {"model": model | {"vocab": vocab, "merges": merges, "byte_fallback": True}, "pre_tokenizer": split, "post_processor": None, "decoder": None}


def library(path: str):
    """The library's tokenizer of a file, loaded once in each worker process."""
    if path not in _libraries:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own, made = None, spelled(spec)
        if made is not None:
            own = Tokenizer.from_str(json.dumps(made))
        if own is None or any(own.token_to_id(t["content"]) != t["id"] for t in spec["added_tokens"]):
            own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _libraries[path] = own
    return _libraries[path]


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(array("I", e.ids), np.uint32) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


def _files(id_type: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("part", T.IntegerType()), T.StructField("begin", long), T.StructField("n_ids", long), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("file", T.BinaryType())])


def write_dac(docs: DataFrame, tokenizer: str, out: str, doc_id: str = "doc_id", text: str = "text", parts: int | None = None, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all texts, an end id after each, in ascending order of doc_id."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    schema = _files(rows.schema["doc_id"].dataType)
    names_type = to_arrow_type(schema["doc_ids"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, names, n, begin = [], [], 0, 0

        def file() -> pa.RecordBatch:
            ids = np.concatenate(held)
            data = encode_ids(ids, np.cumsum([len(x) for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([begin]), pa.array([len(ids)]), pa.array([names], names_type), pa.array([data])], names=schema.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                piece = batch.slice(lo, 64)
                for name, ids in zip(piece.column(0).to_pylist(), encode_texts(tokenizer, piece.column(1).to_pylist()), strict=True):
                    held.append(np.append(ids, np.uint32(END_ID)))
                    names.append(name)
                    n += len(ids) + 1
                    if n >= file_ids:
                        yield file()
                        begin += n
                        held, names, n = [], [], 0
        if held:
            yield file()

    with_batches(spark)
    rows.mapInArrow(run, schema).write.parquet(out)


def read_dac(spark, path: str, id_type: T.DataType | None = None, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if kept, the ids."""
    id_type = id_type or T.LongType()
    files = spark.read.schema(_files(id_type)).parquet(path)
    #: One row for each partition that wrote: as many as write_dac was told to make.
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part] = total
        total += n
    fields = [T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * keep_ids
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, begin, names, data = (batch.column(c)[row].as_py() for c in ("part", "begin", "doc_ids", "file"))
                file, at = DacFile(data), base[part] + begin
                out: list[list] = [names, [], [], []] + [[]] * keep_ids
                for ids in file.documents():
                    out[1].append(at)
                    out[2].append(len(ids))
                    out[3].append(zlib.crc32(ids.tobytes()))
                    if keep_ids:
                        out[4].append(ids)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[f.name for f in fields])

    with_batches(spark)
    return files.select("part", "begin", "doc_ids", "file").mapInArrow(run, T.StructType(fields))


def token_files(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Writes the files to the shared folder and gives what reading them back gives."""
    path = new_path(docs.sparkSession, "dac")
    write_dac(docs, tokenizer, path, doc_id, text)
    return read_dac(docs.sparkSession, path, docs.schema[doc_id].dataType, keep_ids)
