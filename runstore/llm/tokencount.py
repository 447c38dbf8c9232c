"""Token counts by heap-and-linked-list byte-pair merging (operator 8).

Each chunk of the split pattern starts as one symbol a byte in a doubly linked list.  A heap holds the
adjacent pairs that have a merge; the one of lowest rank (leftmost on ties) is popped again and again,
stale entries are recognised by the symbols' generation.  The count is initial symbols minus merges; no
id is ever emitted.  Special tokens that the file lists are cut out first and count one each, which is
the library's default.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows count each; extra columns pass
through, a column named like an output is replaced.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runstore.llm.common import Memo, Splitter, map_texts

MAX_WORDS = 600_000


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters are themselves, the other bytes follow from U+0100 in order."""
    out, extra = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Counter:
    """Counts tokens as the library would for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] is not None or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        of, vocab = printable_bytes(), model["vocab"]
        number = {name: i for i, name in enumerate(vocab)}
        self.first = [0] * 256
        for name, i in number.items():
            if len(name) == 1 and name in of:
                self.first[of[name]] = i
        #: (left symbol, right symbol) -> (rank, merged symbol)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[number[a], number[b]] = (rank, number[a + b])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = Splitter()
        self.words = Memo(lambda word: self.merged(word.encode("utf-8")), MAX_WORDS)

    def merged(self, data: bytes) -> int:
        """Symbols left after all merges."""
        n = len(data)
        if n < 2:
            return n
        merges, symbol = self.merges, [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found is not None:
                heap.append((found[0], i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # one of the two was merged meanwhile
            symbol[i] = new = merges[left, right][1]
            symbol[j] = -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, symbol[k]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, new, symbol[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], new))
                if found is not None:
                    heapq.heappush(heap, (found[0], h, symbol[h], new))
        return n - done

    def plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        if not any(map(text.__contains__, self.added)):
            return self.plain(text)
        total = at = 0
        for match in self.special.finditer(text):
            total += self.plain(text[at : match.start()]) + 1
            at = match.end()
        return total + self.plain(text[at:] if at else text)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs without the text, plus n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    outputs = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def start():
        if path not in _counters:
            _counters[path] = Counter(path)
        count = _counters[path].count

        def work(texts):
            ns = [count(t) if t else 0 for t in texts]
            return {"n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts], "n_tokens": ns, "over_limit": [n > limit for n in ns]}

        return work

    return map_texts(docs, text, outputs, start)
