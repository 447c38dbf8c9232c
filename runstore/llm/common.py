"""What the operators share: scratch tables, Arrow row mapping and column-name hygiene.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor
never takes a result with it; only where that setting is missing (tests, notebooks) a temporary folder
of this machine is used.  They stay until the Python process ends, because lazy results read them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runstore.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to a Python operator at once; with texts of a few MB this stays within a small worker.
SUB_BATCH = 128

#: Bits of the bitmap by which ``parted`` decides at most (16 MB), for each key if there is room, and words of one of its rows.
MOST_BITS, KEY_BITS, ROW_WORDS = 1 << 27, 32, 1024

_own_dir: str | None = None
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="runstore-llm-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/runstore-llm/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: the lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(rows: DataFrame, keys: DataFrame, by: list[str], most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that surely have none), so that only the first need move to meet the keys.

    A bitmap of the keys' hashes goes to where the rows are; it is ``most`` bits at most, whatever the number of keys: then
    more rows may have one.  Both have the columns ``by``; null is a value like any other.
    """
    spark = rows.sparkSession
    row, all_ = ("_" * (1 + max(map(len, rows.columns))) + x for x in ("row", "words"))  # names that rows doesn't have
    bits = min(most, 1 << max(16, (KEY_BITS * keys.count()).bit_length()))
    hashed = F.xxhash64(*[quoted(c) for c in by]).bitwiseAND(F.lit(bits - 1).cast("long"))
    bit, word = hashed.bitwiseAND(F.lit(63).cast("long")).cast("int"), F.shiftright(hashed, 6)
    found = keys.select(word.alias("_word"), bit.alias("_bit")).select("_word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit")).alias("_bits"))
    found = found.unionByName(spark.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits")))  # no word is left out
    found = found.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).groupBy(F.shiftright("_word", ROW_WORDS.bit_length() - 1).alias(row))
    words = F.transform(F.sort_array(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"])
    table = kept(found.agg(words.alias(all_)), "bitmap")
    at = F.element_at(all_, word.bitwiseAND(F.lit(ROW_WORDS - 1).cast("long")).cast("int") + 1)
    met = (F.shiftright(hashed, 6 + ROW_WORDS.bit_length() - 1) == F.col(row)) & (F.getbit(at, bit) == 1)
    return rows.join(F.broadcast(table), met, "left_semi"), rows.join(F.broadcast(table), met, "left_anti")


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already; what is left lies in the scratch folder
            return


class Memo(dict):
    """What ``make`` gives for a word; short words are kept, up to ``most`` of them: when half that many are new, those before go
    unless they are met again."""

    def __init__(self, make: Callable, most: int, longest: int = 256):
        super().__init__()
        self.make, self.most, self.longest, self.before = make, most, longest, {}

    def __missing__(self, word: str):
        value = self.before.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most // 2:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


#: The split that a ByteLevel pre-tokenizer with use_regex makes (fixed value of that format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What it amounts to on ASCII; no other branch can match where a contraction begins, so words may come first.
_ASCII = re.compile(r""" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
_PLAIN = regex.compile(r""" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class Splitter:
    """The matches of a split pattern; those of a very long text one by one."""

    def __init__(self, pattern: str = BYTE_LEVEL):
        known = pattern == BYTE_LEVEL
        self.any, self.ascii = (_PLAIN, _ASCII) if known else [regex.compile(pattern)] * 2

    def __call__(self, text: str):
        pattern = self.ascii if text.isascii() else self.any
        if len(text) <= 1_000_000:
            return pattern.findall(text)
        return (m[0] for m in pattern.finditer(text))


def columns_but(df: DataFrame, names: list[str]) -> list[str]:
    """df's columns except those that an output column of the same name (any case) replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def has(df: DataFrame, name: str) -> bool:
    return name.lower() in (c.lower() for c in df.columns)


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_texts(
    df: DataFrame,
    text: str,
    outputs: T.StructType,
    start: Callable[[], Callable[[list], dict[str, list]]],
    drop_text: bool = True,
) -> DataFrame:
    """df plus the columns ``outputs`` computed in Python from the text column, batch by batch.

    ``start`` runs once in each task and returns the function from a list of texts (None for null) to
    lists of values by output name; its attribute ``close``, if it has one, is called at the task's end.  An input column with an output's name is replaced.
    """
    keep = columns_but(df, outputs.names)
    if drop_text or not has(df, text) or text.lower() not in (k.lower() for k in keep):
        keep = [k for k in keep if k.lower() != text.lower()]
    value = "_text_" if not drop_text else "_text_only_"
    source = df.select(*[F.col(quoted(k)) for k in keep], F.col(quoted(text)).alias(value))
    schema = T.StructType([source.schema[k] for k in keep] + list(outputs.fields))
    names, at = outputs.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, SUB_BATCH):
                part = batch.slice(lo, SUB_BATCH)
                made = work(part.column(at).to_pylist())
                arrays = [part.column(i) for i in range(at)] + [
                    v if isinstance(v := made[n], pa.Array) else pa.array(v, kinds[n]) for n in names
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])
        getattr(work, "close", int)()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in outputs.fields}
    with_batches(df.sparkSession)
    return source.mapInArrow(run, schema)


def with_batches(spark: SparkSession) -> None:
    """Readies the session for Python operators: the package on the workers, Arrow batches small enough for workers of a few hundred MB, unless the session chose less."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 256:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
