"""SimHash near-duplicates by BK-trees over shards of fingerprints (operator 3).

Fingerprints are taken from whole texts in Python, then everything works on *distinct* fingerprints, so a
group of exact copies is one row from there on.  Two fingerprints within ``radius`` bits agree on all bits of at least
n - radius of n bit blocks, so each fingerprint is dealt to one shard for every choice of that many blocks and no link is lost.
As many bits of these blocks make the key as give shards of about ``MEMBERS`` members, at any number of fingerprints.  In each
shard a BK-tree is built: children hang on integer Hamming distances to their parent's pivot, a query follows only the
edges within the radius, and the last few fingerprints of a branch (``LEAF``) are compared directly.  All members are queries.
A shard of more than ``MOST`` members is dealt again by the bits that its key leaves, so no task ever holds more.  A shard only tells which
of its fingerprints are connected, as links to the smallest of each component, never all pairs; what is known to be
connected already is not searched again.  Components over all shards come from alternating large-star and small-star
steps on the (few) links, each round written to the shared folder; nodes of many links are joined by a broadcast of at most 1,024 rows.

**Deviation:** queries are dealt to the shard trees instead of the trees being broadcast.  All trees together are all distinct fingerprints,
which grow with the data; and within 4 of 64 bits a tree only rules out some half of its members, so that passing every query by every tree costs time
with the square of the data.

``keep_one``, the pipeline's stage, has settings of its own: near copies are texts with a Jaccard similarity of 0.8
or more over 5-word shingles.  At 0.8 about ten of 64 bits differ, too many for bit blocks, so shards of the
stage are MinHash bands of six rows (of 32 bands a pair at 0.8 shares one with 99.99 %); the BK-tree of a shard finds fingerprints within
``NEAR_RADIUS`` bits (a pair at 0.8 is within them with 99.99 % too).  These candidates are then compared exactly.

Defined cases: null or wordless text has fingerprint zero and is linked like any other; null doc_ids never
name a component (null if it has no other); repeated rows are kept; equal fingerprints (ties) are one node; very long texts are hashed whole, in pieces; an empty
table gives an empty result; extra columns pass through, one named like an output (fp, fingerprint, component_id, in any case) is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runstore.llm.common import columns_but, kept, map_texts, parted, quoted, with_batches

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a shard that keys aim at, members from which it is dealt again, and members of a leaf.
MEMBERS, MOST, LEAF = 2048, 16_384, 8
#: Queries that go down a tree together, which bounds the distance matrix of a leaf.
TOGETHER = 2048
CHUNK = 65_536
#: ``keep_one``: words of a shingle and the similarity from which texts are near copies (the general rule for
#: word shingles, not operator 3's contract), MinHash bands and rows of each, bits within which candidates lie.
NEAR_SHINGLE, SIMILAR, BANDS, BAND_ROWS, NEAR_RADIUS = 5, 0.8, 32, 6, 22
#: Texts of a lot of candidates that are compared in one task; a larger lot is cut into pieces, compared two at a time.
LOT = 1024


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII blanks split


def hashes(words: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, in pieces; one of all the words where there are no more than make a shingle."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    total = len(words) - shingle + 1
    for lo in range(0, total, CHUNK):
        hi = min(total, lo + CHUNK)
        part = words[lo : hi + shingle - 1]
        line, ends, at = b" ".join(part), [], -1
        for w in part:
            at += 1 + len(w)
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[: hi - lo - 1]]
        yield np.fromiter([digest(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64, hi - lo)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half the hashes of the text's shingles."""
    words = split(text)
    if not words:
        return 0
    total, votes = 0, np.zeros(64, np.int64)
    for h in hashes(words, shingle, seed):
        total += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


class BkTree:
    """A BK-tree whose branches end in small leaves; nodes are (pivot, {distance: child}) or arrays of members."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.nodes = fps, 0
        self.root = self._build(np.arange(len(fps)))

    def _build(self, own: np.ndarray):
        if len(own) <= LEAF:
            return own
        self.nodes += 1
        d = np.bitwise_count(self.fps[own] ^ self.fps[own[0]])
        order = np.argsort(d, kind="stable")
        edges, first = np.unique(d[order], return_index=True)
        return own[0], {int(k): self._build(part) for k, part in zip(edges, np.split(own[order], first[1:]), strict=True)}

    def meet(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) that may be within the radius of each other, by the leaves they reach."""
        todo = [(self.root, queries)]
        while todo:
            node, q = todo.pop()
            if isinstance(node, np.ndarray):
                yield q, node
                continue
            d = np.bitwise_count(self.fps[q] ^ self.fps[node[0]]).astype(np.int16)
            for edge, child in node[1].items():
                near = q[np.abs(d - edge) <= radius]
                if len(near):
                    todo.append((child, near))


def connected(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints of a shard, sorted: the smallest index that each is connected with."""
    label = np.arange(len(fps))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            pairs = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if not pairs.shape[1]:
                return
            new = np.arange(len(fps))
            np.minimum.at(new, pairs[1], pairs[0])
            while True:  # short chains of roots
                nxt = new[new]
                if (nxt == new).all():
                    break
                new = nxt
            label[:] = new[label]

    if len(fps) < 2:
        return label
    if len(fps) == 2:  # most shards
        return label * (int(fps[0] ^ fps[1]).bit_count() > radius)
    tree = BkTree(fps)
    for lo in range(0, len(fps), TOGETHER):
        for q, members in tree.meet(np.arange(lo, min(len(fps), lo + TOGETHER)), radius):
            if (label[q] == label[q[0]]).all() and (label[members] == label[q[0]]).all():
                continue
            near = np.bitwise_count(fps[q][:, None] ^ fps[members][None, :]) <= radius
            near &= label[q][:, None] != label[members][None, :]
            if near.any():
                a, b = np.nonzero(near)
                join(q[a], members[b])
    return label


def masks(radius: int, bits: int, free: int = (1 << 64) - 1) -> list[int]:
    """Masks of at most ``bits`` of the free bits, one for each choice of all but ``radius`` of so few blocks that
    these hold as many bits: whatever differs in ``radius`` bits agrees on one of the masks."""
    places = [i for i in range(64) if free >> i & 1]
    if bits <= 0 or len(places) <= radius:
        return [0]
    for blocks in range(radius + 1, len(places) + 1):
        if (blocks - radius) * (len(places) // blocks) >= bits or blocks == min(len(places), radius + 4):
            break
    cuts = [round(len(places) * i / blocks) for i in range(blocks + 1)]
    each = [places[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(1 << i for i in [i for block in c for i in block][:bits]) for c in combinations(each, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(fps: DataFrame, radius: int = RADIUS, members: int = MEMBERS, most: int = MOST) -> DataFrame:
    """(m, key, fp): each fingerprint in every shard that anything within the radius shares with it."""
    spark, n = fps.sparkSession, fps.count()
    level = dict(enumerate(masks(radius, math.ceil(math.log2(max(1, n) / members)))))
    to = lambda shards: F.explode(F.transform(shards, lambda x: F.struct(x["m"].alias("m"), F.col("fp").bitwiseAND(x["mask"]).alias("key")))).alias("s")
    table = lambda ms: [(i, signed(m)) for i, m in ms.items()]
    now = fps.select("fp", to(F.array(*[F.struct(F.lit(i).alias("m"), F.lit(m).cast("long").alias("mask")) for i, m in table(level)]))).select("s.m", "s.key", "fp")
    done = None
    while n > most and any(64 - m.bit_count() > math.log2(most) for m in level.values()):
        hot = kept(now.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("m", "key"), "hot-shards")
        if hot.isEmpty():
            break
        cold = now.join(hot, ["m", "key"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        # the bits that the key leaves are cut anew: a few rows for each mask of the level
        finer, rows, number = {}, [], max(level) + 1
        for i, m in level.items():
            own = {number + j: m | x for j, x in enumerate(masks(radius, 8, ~m & (1 << 64) - 1))}
            number += len(own)
            finer |= own
            rows.append((i, table(own)))
        again = spark.createDataFrame(rows, "m int, shards array<struct<m:int,mask:long>>")
        now = kept(now.join(hot, ["m", "key"], "left_semi").join(F.broadcast(again), "m").select("fp", to(F.col("shards"))).select("s.m", "s.key", "fp"), "finer-shards")
        level = finer
    return now if done is None else done.unionByName(now)


def by_shard(shards: DataFrame, keys: list[str], values: list[str], work: Callable) -> DataFrame:
    """(a, b) that ``work`` finds in each shard, given its columns ``values`` as arrays, sorted by the first."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shards.select(*keys, *values).repartition(parts, *keys).sortWithinPartitions(*keys, *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(pieces: list[list[np.ndarray]]):
            return work(*[np.concatenate(x) for x in zip(*pieces, strict=True)])

        now, held = None, []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = np.nonzero(np.any([np.diff(c) != 0 for c in columns[: len(keys)]], axis=0))[0] + 1
            bounds = [0, *cut.tolist(), batch.num_rows]
            out = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                shard = tuple(c[lo] for c in columns[: len(keys)])
                if shard != now and held:
                    out.append(found(held))
                    held = []
                now = shard
                held.append([c[lo:hi] for c in columns[len(keys) :]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(held)], names=["a", "b"])

    with_batches(shards.sparkSession)
    return rows.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = RADIUS, members: int = MEMBERS, most: int = MOST) -> DataFrame:
    """(a, b): fingerprints of one component of a shard, b the smallest there; fps: distinct fp long."""

    def work(own: np.ndarray):
        label = connected(own.view(np.uint64), radius)
        linked = label != np.arange(len(own))
        return own[linked], own[label[linked]]

    return by_shard(dealt(fps, radius, members, most), ["m", "key"], ["fp"], work)


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(a, root): for each linked node, the smallest node that it is connected with."""

    def with_low(d: DataFrame, low: DataFrame, n: int) -> DataFrame:
        """d with a's ``low``; no more than 1,024 nodes can hold a 512th of the links' ends each, and these are sent to where the links are."""
        hot = F.broadcast(low.where(F.col("n") > max(64, n // 512)).drop("n"))
        rest = d.join(hot.select("a"), "a", "left_anti").join(low.where(F.col("n") <= max(64, n // 512)).drop("n"), "a")
        return d.join(hot, "a").unionByName(rest)

    def step(e: DataFrame, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = with_low(both, low, n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = kept(large.where("a <> b").distinct(), name + "-large")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = with_low(large, low, n).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return small.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), name)
    before = mark(now)
    while before[0]:
        now = kept(step(now, before[0]), name)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select("a", F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without the text, plus fp (long), fingerprint (16 hex digits) and component_id."""

    def start():
        return lambda texts: {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    docs = docs.select(*[quoted(c) for c in columns_but(docs, ["fp", "fingerprint", "component_id"])])
    rows = kept(map_texts(docs, text, T.StructType([T.StructField("fp", T.LongType())]), start), "fingerprints")
    fps = kept(rows.groupBy("fp").agg(F.min(doc_id).alias("first")), "distinct")
    roots = components(links(fps.select("fp"), radius)).withColumnRenamed("a", "fp")
    known = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = known.join(roots.select("root").distinct(), "root", "left_semi")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = fps.join(linked.join(ids, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # written first: a join of two exchanges can have its hot fingerprints split, one that reuses a partitioning can't
    return rows.join(kept(of, "components"), "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; none for a text without words."""
    words = split(text)
    return np.unique(np.concatenate(list(hashes(words, shingle, seed)))) if words else np.zeros(0, np.uint64)


def band_keys(own: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """MinHash keys of a set: two sets share that of a band where their least hashes are the same for all its rows."""
    if not len(own):
        return []
    by = np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 512):
        low = np.minimum(low, (own[lo : lo + 512, None] * by).min(axis=0))
    return [signed(xxhash.xxh64_intdigest(low[i * rows : (i + 1) * rows].tobytes(), i)) for i in range(bands)]


def similar_groups(sets: list[np.ndarray], least: float = SIMILAR) -> np.ndarray:
    """For each set the first one that it is connected with by Jaccard similarities of at least ``least``; exact."""
    size, label = np.array([len(s) for s in sets], np.int64), np.full(len(sets), -1)
    todo, left, built, at = [], len(sets), 0, 0
    while left:
        if not todo:
            while label[at] >= 0:
                at += 1
            label[at] = at
            todo.append(at)
            left -= 1
        if not built or 2 * left < built:  # an index of what is not yet in a group
            own = np.nonzero(label < 0)[0]
            keys, owner, built = np.concatenate([sets[i] for i in own] or [np.zeros(0, np.uint64)]), np.repeat(own, size[own]), max(1, len(own))
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
        q = todo.pop()
        lo, hi = np.searchsorted(keys, sets[q], "left"), np.searchsorted(keys, sets[q], "right")
        n = hi - lo
        met, both = np.unique(owner[np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())], return_counts=True)
        near = met[(label[met] < 0) & (both >= least * (size[met] + size[q] - both) - 1e-9)]
        label[near] = label[q]
        todo += near.tolist()
        left -= len(near)
    return label


def votes(own: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > len(own)).astype(np.uint8), bitorder="little").view("<u8")[0])


def near_groups(docs: DataFrame, text: str = "text", lot: int = LOT, most: int = MOST) -> DataFrame:
    """docs without the text, plus root (long): the same for texts connected by similarities of at least SIMILAR.

    Texts of equal shingle sets are one node.  The nodes that share a MinHash band are a shard; those of them whose
    fingerprints the shard's BK-tree connects are candidates (all of them in a shard of more than ``most``).  What candidates connect is a
    lot, whose sets are compared exactly: in one task up to ``lot`` texts, beyond that by pieces of about that many, each with itself and each other one.
    """

    def start():
        def made(texts):
            sets = [shingle_set(t) for t in texts]
            return {"node": [signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], "fp": [signed(votes(s)) for s in sets], "bands": [band_keys(s) for s in sets]}

        return made

    def work(node: np.ndarray, fp: np.ndarray):
        order = np.argsort(fp, kind="stable")
        fps, of = np.unique(fp[order], return_inverse=True)
        label = connected(fps.view(np.uint64), NEAR_RADIUS)[of]  # of each node, its component
        low = np.full(len(fps), np.iinfo(np.int64).max)
        np.minimum.at(low, label, node[order])
        linked = node[order] != low[label]
        return node[order][linked], low[label[linked]]

    h = F.xxhash64(F.col(quoted(text)))
    made = T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = kept(map_texts(docs.withColumn("_text_hash_", h), text, made, start), "shingles")
    nodes = kept(rows.select("node", "fp", "bands").distinct(), "nodes").select("node", "fp", F.explode("bands").alias("band"))
    shared = kept(nodes.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "bands")
    members = parted(nodes, shared, ["band"])[0].join(shared, "band")  # most bands have one node
    found = by_shard(members.where(F.col("n") <= most), ["band"], ["node", "fp"], work)
    every = members.where((F.col("n") > most) & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b").distinct()
    lots = components(found.unionByName(every), "candidates")
    lots = lots.unionByName(lots.select(F.col("root").alias("a"), "root")).distinct().withColumnRenamed("a", "node")
    # one text of each candidate
    lots = kept(rows.join(lots, "node").groupBy("node").agg(F.min("_text_hash_").alias("_text_hash_"), F.first("root").alias("lot")), "lots")
    pieces = lots.groupBy("lot").agg(F.count("*").alias("n")).select("lot", F.ceil(F.col("n") / lot).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    lots = kept(lots.join(pieces, "lot").select("node", "_text_hash_", "lot", F.explode(pairs).alias("x")).select("node", "_text_hash_", "lot", "x.i", "x.j"), "pieces")
    wanted = kept(lots.select("_text_hash_").distinct(), "wanted")
    texts, _ = parted(docs.select(h.alias("_text_hash_"), F.col(quoted(text)).alias("text")), wanted, ["_text_hash_"])  # other texts don't move
    texts = texts.dropDuplicates(["_text_hash_"]).join(wanted, "_text_hash_", "left_semi")

    def compared(frame):
        frame = frame.sort_values("node", ignore_index=True)
        label = similar_groups([shingle_set(t) for t in frame["text"]])
        return frame[["node"]].rename(columns={"node": "a"}).assign(b=frame["node"].to_numpy()[label])

    with_batches(docs.sparkSession)
    similar = texts.join(lots, "_text_hash_").groupBy("lot", "i", "j").applyInPandas(compared, "a long, b long").where("a <> b")
    roots = kept(components(similar, "similar").withColumnRenamed("a", "node"), "roots")
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node", "fp", "bands", "_text_hash_")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near copies (see ``near_groups``): that of the smallest id, null last, then of the smallest text hash.

    A row is known by id and text hash, so an id that is used for two texts that are no near copies loses
    neither; of rows that are repeated one stays.  Only texts that may go move (see ``parted``).
    """
    h = F.xxhash64(F.col(quoted(text)))
    keyed = docs.withColumns({"_id_": F.col(quoted(doc_id)), "_hash_": h})
    found = kept(near_groups(keyed.select("_id_", "_hash_", F.col(quoted(text)).alias("text"))), "groups")
    order = F.struct(F.col("_id_").isNull().alias("none"), F.col("_id_").alias("id"), F.col("_hash_").alias("hash"))
    first = found.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("root", "first")
    first = kept(first, "first")  # so that the join can have its hot roots split
    gone = kept(found.join(first, "root").where(order != F.col("first")).select("_id_", "_hash_").distinct(), "gone")
    twice = found.groupBy("_id_", "_hash_").agg(F.count("*").alias("n")).where("n > 1").select("_id_", "_hash_")
    twice = kept(twice, "repeated")

    def less(rows: DataFrame, t: DataFrame, how: str) -> DataFrame:
        t = t.select(F.col("_id_").alias("_i_"), F.col("_hash_").alias("_h_"))
        return rows.join(t, F.col("_id_").eqNullSafe(F.col("_i_")) & (F.col("_hash_") == F.col("_h_")), how)

    may, rest = parted(keyed, gone.unionByName(twice), ["_id_", "_hash_"])
    stay = less(may, gone, "left_anti")
    if not twice.isEmpty():
        stay = less(stay, twice, "left_anti").unionByName(less(stay, twice, "left_semi").dropDuplicates(["_id_", "_hash_"]))
    return rest.unionByName(stay).select(*[quoted(c) for c in docs.columns])
