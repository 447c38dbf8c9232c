"""Shards of near equal bytes by histogram sort (operator 9); DataFrame operations only.

Rows are ordered by (hash of the text, hash of doc_id, row number), so that equal texts lie side by side.
Splitters are found without moving rows: in each round the interval that holds a splitter is cut
at evenly spaced probes, the exact bytes between probes are counted across all partitions (pre-aggregated;
at most PROBES rows for each splitter reach the driver), and the interval shrinks to the bin that the
target falls in, until a boundary is within the tolerance.  When all rows of a bin have one key value, as
with a hot group of equal texts, the search goes on in the next key, so such a group is split too, while a
group smaller than the tolerance never is.  Then rows are exchanged once, by ranges of (shard, keys).

Law: ``bytes``.  Size is the UTF-8 length of the text (null: none) plus 1.  Defined cases: null
texts and null doc_ids hash like a value of their own; repeated rows are told apart by row number; an empty
table gives an empty result; a row larger than a shard leaves neighbours empty; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runstore.llm.common import columns_but, kept, quoted

PROBES = 1024
#: How far a boundary may lie from its target, as a share of a shard.
TOLERANCE = 0.0005
KEYS = ("_k0", "_k1", "_k2")


def splitters(rows: DataFrame, targets: list[float], slack: float, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """Lower bounds of the shards after the first: the lowest key that belongs to each."""
    span = rows.agg(*[f(k).alias(f"{n}{k}") for k in KEYS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if span["lo_k0"] is None:
        return [(0, 0, 0)] * len(targets)
    whole = {"fixed": (), "lo": span["lo_k0"], "hi": span["hi_k0"], "before": 0}
    state, found = {i: whole for i in range(len(targets))}, {}
    while state:
        open_ = list({(s["fixed"], s["lo"], s["hi"]): s for s in state.values()}.values())
        number = None
        for n, s in enumerate(open_):
            key, width = F.col(KEYS[len(s["fixed"])]), -(-(s["hi"] - s["lo"] + 1) // probes)
            inside = key.between(s["lo"], s["hi"])
            for k, v in zip(KEYS, s["fixed"], strict=False):
                inside &= F.col(k) == v
            bin_ = F.expr(f"{n * probes} + ({KEYS[len(s['fixed'])]} - {s['lo']}) div {width}")
            number = F.when(inside, bin_) if number is None else number.when(inside, bin_)
        bins = rows.select(number.alias("bin"), "size", *KEYS).where("bin is not null").groupBy("bin")
        counted = bins.agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{n}{k}") for k in KEYS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r["bin"]):
            by.setdefault(r["bin"] // probes, []).append(r)
        where = {(s["fixed"], s["lo"], s["hi"]): n for n, s in enumerate(open_)}
        for i, s in list(state.items()):
            at = s["before"]
            mine = by[where[s["fixed"], s["lo"], s["hi"]]]
            for j, r in enumerate(mine):
                if at + r["bytes"] >= targets[i] or j == len(mine) - 1:
                    break
                at += r["bytes"]
            k = len(s["fixed"])
            low, high = (*s["fixed"], r[f"lo{KEYS[k]}"]), (*s["fixed"], r[f"hi{KEYS[k]}"] + 1)
            near_low, near_high = abs(targets[i] - at), abs(at + r["bytes"] - targets[i])
            one = r[f"lo{KEYS[k]}"] == r[f"hi{KEYS[k]}"]
            if min(near_low, near_high) <= slack or (one and k == len(KEYS) - 1):
                found[i] = low if near_low <= near_high else high
                del state[i]
            elif one:
                nxt = KEYS[k + 1]
                state[i] = {"fixed": low, "lo": r[f"lo{nxt}"], "hi": r[f"hi{nxt}"], "before": at}
            else:
                state[i] = {"fixed": s["fixed"], "lo": low[-1], "hi": high[-1] - 1, "before": at}
    return [(*found[i], *[0] * (len(KEYS) - len(found[i]))) for i in range(len(targets))]


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, tolerance: float = TOLERANCE) -> DataFrame:
    """docs plus size, text_crc32, law, shard, slot (0.. without gaps in each shard) and grown_shard (null)."""
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", *KEYS, "_at"]
    own = [c for c in columns_but(docs, made) if keep_text or c.lower() != text.lower()]
    t = F.col(quoted(text))
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 2)  # noqa: E731  62 bits: differences don't overflow
    rows = docs.select(
        *[quoted(c) for c in own],
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        hashed(t).alias("_k0"),
        hashed(F.col(quoted(doc_id)), F.lit("id")).alias("_k1"),
        F.monotonically_increasing_id().alias("_k2"),
    )
    rows = kept(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = splitters(rows, [total * i / shards for i in range(1, shards)], tolerance * total / shards)
    key = F.struct(*KEYS)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + F.when(key >= F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEYS, b, strict=True)]), 1).otherwise(0)
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", *KEYS]
    placed = rows.withColumn("shard", shard.cast("int")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = kept(placed.withColumn("_at", F.monotonically_increasing_id()), "placed")
    # one row for each partition and shard in it: at most parts + shards rows
    part = F.shiftright("_at", 33)
    runs = placed.groupBy("shard", part.alias("part")).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"), (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("_base"))
    out = placed.join(F.broadcast(runs), (F.col("shard") == F.col("_shard")) & (part == F.col("_part")))
    return out.select(*[quoted(c) for c in own], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") + F.col("_base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **names) -> None:
    """The documents as Parquet, a folder for each shard, rows in slot order within each file."""
    shard_documents(docs, shards, **names).write.partitionBy("shard").parquet(path)
