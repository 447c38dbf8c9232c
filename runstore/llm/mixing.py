"""Mixing sources to target weights by subset-sum budget fitting (operator 1).

Documents are counted by exact length within each source.  A source's target is met in three steps: whole
repeats of the source as long as they fit, then the same share of every length (so that the mix keeps the
source's lengths; remainders are drawn by seed with a chance that follows their size), and then a bounded-knapsack
programme that finds the sum nearest below the budget.  It works on a window of lengths around the border of the draw, each of
which may move a few documents up or down, on whichever side is smaller, what to take or what to leave out.
Unless the sum meets the budget exactly, which can't be bettered, the window grows until it holds every length with
all its documents; then the sum is the nearest there is.  **Bound:** a window of more than ``PROGRAMME`` words (on its
smaller side, after division by the lengths' common divisor) and more than ``SUMS`` distinct sums isn't tried, so in a source
larger than that a gap may remain that is least only within the widest window tried.

Which documents of a length are taken is drawn by seed: those of lowest hash.  Hashes fall into slices (``SLICES``, or one for every
``SLICE_ROWS`` rows if that is more); whole slices are taken without ranking, and only the slice in which a
length's last document lies is ranked, by its distinct hashes.  Rows that are repeated share a hash: of those at the border any may be taken, and
which ones is settled within each partition from counts over all, so that no task ranks a hot length or a hot row.

The programme sees one entry for each distinct length of a source, in one task for each source: their number is bounded by
the longest document, not by the documents.  Sources' totals, targets and plans stay tables, which are joined by Spark as their size
allows; nothing is gathered on the driver.

Defined cases: null text has size 0; null source is a source of its own and comes last; a source without
words has target 0 and takes nothing; documents without words are never taken; repeated rows are drawn each; an
empty table gives an empty mix; very long texts are counted whole; extra columns pass through, one named like an output
(size, source_size, target, copies, taken, in any case) is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runstore.llm.common import columns_but, kept, quoted, with_batches, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
SLICES, SLICE_ROWS = 256, 1 << 20
SEED = 20
#: Widest programme: words on its smaller side, or distinct sums.
PROGRAMME, SUMS = 1 << 24, 1 << 16
#: Lengths in the first window, and by how much windows grow.
WINDOW, GROWTH = 4, 2
_PIECE = 1 << 17


class Sums:
    """Which sums up to ``widest`` the lengths can make, and how; stops as soon as ``goal`` is among them."""

    def __init__(self, lengths: list[int], most: list[int], widest: int, goal: int):
        self.items, self.reach, self.n = [], 1, len(lengths)
        self.first = np.full(widest + 1, -1, np.int32)  # the item with which each sum was first reached
        mask = (1 << (widest + 1)) - 1
        for at, (length, n) in enumerate(zip(lengths, most, strict=True)):
            n, piece = min(n, widest // length), 1
            while n > 0:  # counts as sums of powers of two
                take = min(piece, n)
                new = (self.reach << take * length) & mask & ~self.reach
                if new:
                    raw = np.frombuffer(new.to_bytes(widest // 8 + 1, "little"), np.uint8)
                    for lo in range(0, len(raw), _PIECE):
                        hit = np.nonzero(np.unpackbits(raw[lo : lo + _PIECE], bitorder="little"))[0]
                        self.first[hit + 8 * lo] = len(self.items)
                    self.items.append((at, take, take * length))
                    self.reach |= new
                n -= take
                piece *= 2
            if self.reach >> goal & 1:
                break

    def counts(self, value: int) -> list[int]:
        out = [0] * self.n
        while value:
            at, take, words = self.items[self.first[value]]
            out[at] += take
            value -= words
        return out


def few_sums(lengths: list[int], most: list[int], budget: int) -> list[int]:
    """Counts of the sum nearest below the budget, by listing all sums."""
    sums: dict[int, tuple] = {0: ()}
    for at, (length, n) in enumerate(zip(lengths, most, strict=True)):
        for value, how in list(sums.items()):
            for k in range(1, n + 1):
                if (new := value + k * length) <= budget:
                    sums.setdefault(new, (*how, (at, k)))
    out = [0] * len(lengths)
    for at, k in sums[max(sums)]:
        out[at] += k
    return out


def fit(lengths: list[int], most: list[int], budget: int, programme: int = PROGRAMME) -> list[int] | None:
    """Bounded knapsack: how many of each length, so that their sum is nearest below the budget; earlier lengths are
    preferred.  None if the programme would be too wide."""
    spare = sum(a * b for a, b in zip(lengths, most, strict=True)) - budget
    if spare <= 0:
        return list(most)
    # to leave out the least sum of at least ``spare`` is the same choice
    left_out = spare + max(lengths)
    if min(budget, left_out) > programme:
        few = len(most) <= SUMS.bit_length() and math.prod(m + 1 for m in most) <= SUMS
        return few_sums(lengths, most, budget) if few else None
    if budget <= left_out:
        sums = Sums(lengths, most, budget, budget)
        return sums.counts(sums.reach.bit_length() - 1)
    sums = Sums(lengths[::-1], most[::-1], left_out, spare)
    above = sums.reach >> spare
    out = sums.counts(spare + (above & -above).bit_length() - 1)[::-1]
    return [m - x for m, x in zip(most, out, strict=True)]


def drawn(lengths: np.ndarray, seed: int) -> np.ndarray:
    """A seeded number in (0, 1] for each length (splitmix64)."""
    x = lengths.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def plan(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, programme: int = PROGRAMME) -> np.ndarray:
    """How many documents of each (distinct, positive) length to take for the budget, once each."""
    size = int((lengths * counts).sum())
    if budget >= size:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    unit = math.gcd(*lengths.tolist())
    shares = [divmod(int(c) * budget, size) for c in counts]  # exact integers
    take = np.array([whole for whole, _ in shares], np.int64)
    words, left = lengths // unit, budget // unit - int((lengths // unit * take).sum())
    # one more of some lengths, each with a chance that follows its remainder
    with np.errstate(divide="ignore"):
        order = np.argsort(drawn(lengths, seed) / np.array([rest / size for _, rest in shares]), kind="stable")
    border = int(np.searchsorted(np.cumsum(words[order]), left, "right"))
    take[order[:border]] += 1
    left -= int(words[order[:border]].sum())
    wide, room = WINDOW, 1
    while left:
        near = order[max(0, border - wide) : border + wide]
        low, high = np.maximum(0, take[near] - room), np.minimum(counts[near], take[near] + room)
        open_ = high > low
        near, low, high = near[open_], low[open_], high[open_]
        found = fit(words[near].tolist(), (high - low).tolist(), left + int(((take[near] - low) * words[near]).sum()), programme)
        if found is None:
            break
        left += int((words[near] * (take[near] - low - found)).sum())
        take[near] = low + found
        if len(near) == len(order) and not low.any() and (high == counts[near]).all():
            break
        wide, room = wide * GROWTH, room * GROWTH
    return take


def goals(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS, budget: float = 1.0) -> DataFrame:
    """sizes (_s, source_size) plus target: its weight's share of the budget, no more than ``most`` times its size;
    what lies above is shared again by weight until nothing does.  _s is "=" and the source, or empty for null.

    With sources in order of most * size / weight those that are full come first, so one pass of running sums finds them.
    """
    number = F.row_number().over(Window.orderBy(F.col("_s") == "", "_s"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(number - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("_w", weight).withColumn("_cap", (most * F.col("source_size")).cast("double"))
    every, by = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by), F.lit(0.0))
    rows = rows.withColumn("_all", budget * F.sum("source_size").over(every)).withColumn("_left", F.col("_all") - before("_cap")).withColumn("_rest", F.sum("_w").over(every) - before("_w"))
    rows = rows.withColumn("_full", F.col("_left") * F.col("_w") / F.col("_rest") > F.col("_cap"))
    left = F.greatest(F.lit(0.0), F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every))
    share = left * F.col("_w") / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every)
    return rows.select("_s", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep_text: bool = True, budget: float = 1.0, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """docs plus size, source_size, target, copies and taken (copies x size)."""
    made = ["size", "source_size", "target", "copies", "taken", "_s", "_h", "_slice", "_border", "_whole", "_m", "_extra", "_at"]
    own = [c for c in columns_but(docs, made) if keep_text or c.lower() != text.lower()]
    h = F.xxhash64(F.col(quoted(doc_id)), F.xxhash64(F.col(quoted(text))), F.lit(seed))
    key = F.coalesce(F.concat(F.lit("="), F.col(quoted(source))), F.lit(""))
    rows = docs.select(*[quoted(c) for c in own], word_count(F.col(quoted(text))).alias("size"), key.alias("_s"), h.alias("_h"))
    if keep_text:  # texts are read again at the end and never move
        keys = kept(rows.select("_s", "size", "_h"), "sizes")
    else:
        keys = rows = kept(rows, "sizes")
    slices = max(SLICES, -(-keys.count() // SLICE_ROWS))
    at = F.pmod("_h", F.lit(slices)).cast("int")
    counts = kept(keys.groupBy("_s", "size", at.alias("_slice")).agg(F.count("*").alias("n")), "lengths")
    target = goals(counts.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats, budget)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.floor(F.floor("target") / F.greatest("source_size", F.lit(1))))).otherwise(0).cast("long")
    target = kept(target.withColumn("_whole", whole), "targets")

    def planned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        take = plan(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["rest"][0]), seed)
        return frame[["_s", "size"]].assign(take=take)[take > 0]

    with_batches(docs.sparkSession)
    rest = F.when(F.col("_whole") < max_repeats, F.floor("target").cast("long") - F.col("_whole") * F.col("source_size")).otherwise(0)
    lengths = counts.where("size > 0").groupBy("_s", "size").agg(F.sum("n").alias("n")).join(target.select("_s", rest.alias("rest")), "_s")
    take = lengths.groupBy("_s").applyInPandas(planned, "_s string, size long, take long")
    # whole slices are taken until one, the border, holds the length's last document
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_s", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("before", before).join(take, ["_s", "size"]).where("before < take and take <= before + n")
    cut = cut.select("_s", "size", F.col("_slice").alias("_border"), (F.col("take") - F.col("before")).alias("left"))
    marks = kept(counts.select("_s", "size").distinct().join(target, "_s").join(cut, ["_s", "size"], "left"), "plan")
    # in it, documents by hash; one row for each distinct hash
    inside = keys.join(marks.select("_s", "size", "_border", "left").where("left is not null"), ["_s", "size"]).where(at == F.col("_border"))
    inside = inside.groupBy("_s", "size", "_h").agg(F.count("*").alias("_m"), F.first("left").alias("left"))
    so_far = F.coalesce(F.sum("_m").over(Window.partitionBy("_s", "size").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picks = inside.select("_s", "size", "_h", "_m", F.least("_m", F.col("left") - so_far).alias("_extra")).where("_extra > 0")
    picks = kept(picks, "picks")
    out = rows.join(marks.drop("left"), ["_s", "size"]).join(picks, ["_s", "size", "_h"], "left")
    one_more = F.when(at < F.col("_border"), 1).when((at == F.col("_border")) & F.col("_extra").isNotNull(), 1).otherwise(0)
    out = out.withColumn("_one", one_more)
    if not picks.where("_extra < _m").isEmpty():  # some, but not all, of a row that is repeated
        again = kept(out.where("_extra < _m").withColumn("_at", F.monotonically_increasing_id()), "repeated")
        group, part = ["_s", "size", "_h"], F.shiftright("_at", 33).alias("_part")
        runs = again.groupBy(*group, part).agg(F.count("*").alias("n"))
        runs = runs.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        again = again.withColumn("_part", part).join(runs.drop("n"), [*group, "_part"])
        rank = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_at"))
        again = again.withColumn("_one", F.when(F.col("_before") + rank <= F.col("_extra"), 1).otherwise(0))
        out = out.where("_extra is null or _extra = _m").unionByName(again.select(*out.columns))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("_one")).otherwise(0).cast("long")
    return out.select(*[quoted(c) for c in own], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
