"""Byte-level BPE encoding and decoding by a lazily determinised transducer (operator 6).

The merge table is compiled into a nondeterministic transducer: a configuration is a node of the byte
trie of all tokens together with the token that ended where this partial token began.  Reading a byte
moves every live configuration one trie edge on; one that reaches a token which is *compatible* with its
predecessor (the two tokens' bytes, merged by rank, give back just these two) ends it there.  Of all
prefixes of a match exactly one last token is valid, so each configuration has one row of tokens behind it.
A state of the determinised transducer is the set of live configurations with those of their tokens that haven't been
handed out: what all of them agree on is emitted on the move that makes them agree, at most the longest token's
bytes after the token's end, whatever the match's length.  States are built when first met, from then on a byte costs one
dictionary look-up.

Decoding streams token bytes through a byte-wise UTF-8 machine that hands out only complete characters.

Defined cases: null text counts as empty, an empty text has no ids (hash of no bytes; so has an empty table no rows), repeated rows are
encoded each; a very long text is split match by match, a very long match is streamed; equal ranks don't occur, of two equal pairs the left one merges
first; extra columns pass through, a column named like an output (n_tokens, ids_sha256, decoded_sha256, ids, decoded, in any case) is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runstore.llm.common import Memo, Splitter, map_texts

#: Determinised states kept by one encoder; beyond that the table starts afresh (results stay the same).
MAX_STATES = 300_000
MAX_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one match of the split pattern at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.max_states = max_states
        #: The trie: node << 8 | byte -> node; of each node the token that ends there, and whether it has children.
        self.child: dict[int, int] = {}
        self.token_at, self.inner = array("i", [-1]), bytearray(b"\x01")
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = nxt
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        #: state << 8 | byte -> next state, or ~next state if the move emits tokens; those are under the same key.
        self.moves: dict[int, int] = {}
        self.emits: dict[int, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state: of each configuration its trie node, the token before it plus 1, the number of tokens not yet emitted and these, as 32-bit integers.
        self.states: list[bytes] = [array("I", [0, 0, 0]).tobytes()]
        self.number = {self.states[0]: 0}
        self.moves.clear()
        self.emits.clear()

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging by rank until ``stop`` parts are left; used on the bytes of single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or an unreachable token."""
        if token not in self.halves:
            data = self.bytes_of[token]
            parts = self.merged(data, 2) if len(data) > 1 else []
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if left < 0:
                known = len(self.bytes_of[right]) == 1 or self.split(right) is not None
            else:
                known = self.side_by_side(left, right)
            if len(self.pairs) > 2 * self.max_states:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with exactly these two tokens.

        Both are taken apart again, the one made later first.  At each moment of the merging the two
        parts that meet at the border are known; had their merge a rank below that of the next merge
        on either side, it would have come first and the border would be gone.
        """
        ranks, of = self.ranks, self.bytes_of
        if (len(of[left]) > 1 and self.split(left) is None) or (len(of[right]) > 1 and self.split(right) is None):
            return False
        a, b = left, right
        before = None  # the merge that comes next in time: (rank, side), a left one wins on equal ranks
        while True:
            joint = ranks.get(of[a] + of[b])
            if joint is not None:
                if before is None:
                    return False
                rank, on_right = before
                if joint < rank or (joint == rank and on_right):
                    return False
            # which of the two parts was made last (equal parts: the right one, as merging goes left to right)
            a_whole, b_whole = len(of[a]) == 1, len(of[b]) == 1
            if a_whole and b_whole:
                return True
            if b_whole or (not a_whole and a > b):
                before, a = (a, False), self.split(a)[1]
            else:
                before, b = (b, True), self.split(b)[0]

    def move(self, state: int, byte: int) -> tuple[int, list[int]]:
        """The next state and the tokens that are certain from here on; built when first asked for."""
        packed, at, live, ended, child = array("I", self.states[state]).tolist(), 0, [], None, self.child
        while at < len(packed):
            node, before, held = packed[at], packed[at + 1] - 1, packed[at + 3 : at + 3 + packed[at + 2]]
            at += 3 + len(held)
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if ended is None and token >= 0 and self.compatible(before, token):
                ended = (0, token, [*held, token])
            if self.inner[nxt]:
                live.append((nxt, before, held))
        if ended is None:
            raise ValueError(f"no token ends with byte {byte}: the ranks lack single bytes")
        live.append(ended)
        # what all configurations have in front is certain
        first = ended[2]
        same = len(first)
        for _, _, held in live:
            at = 0
            while at < same and at < len(held) and held[at] == first[at]:
                at += 1
            same = at
            if not same:
                break
        out, full = first[:same], len(self.states) >= self.max_states
        if full:
            self._reset()
        packed = []
        for node, before, held in live:
            packed += node, before + 1, len(held) - same
            packed += held[same:]
        key = array("I", packed).tobytes()
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        if not full:  # else the number of the state before is gone
            self.moves[state << 8 | byte] = ~found if out else found
            if out:
                self.emits[state << 8 | byte] = out
        return found, out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one match, each handed out as soon as no later byte can change it."""
        state, get, emits = 0, self.moves.get, self.emits
        for byte in data:
            key = state << 8 | byte
            state = get(key)
            if state is None:
                state, out = self.move(key >> 8, byte)
                yield from out
            elif state < 0:
                state = ~state
                yield from emits[key]
        yield from self._ended(state)

    def _ended(self, state: int) -> list[int]:
        """Tokens held by the configuration that ends here, which is a state's last one."""
        packed, at = array("I", self.states[state]).tolist(), 0
        while at + 3 + packed[at + 2] < len(packed):
            at += 3 + packed[at + 2]
        return packed[at + 3 :]

    def encode(self, data: bytes) -> list[int]:
        return list(self.stream(data))


class Utf8Machine:
    """Incremental UTF-8: feed bytes in any pieces, get the complete characters so far."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def step(self, byte: int) -> bool:
        """Takes a byte; true if a character is complete after it.  Raises on what isn't UTF-8."""
        if self.need == 0:
            if byte < 0x80:
                return True
            if 0xC2 <= byte <= 0xDF:
                self.need = 1
            elif 0xE0 <= byte <= 0xEF:
                self.need = 2
                self.low = 0xA0 if byte == 0xE0 else 0x80
                self.high = 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.need = 3
                self.low = 0x90 if byte == 0xF0 else 0x80
                self.high = 0x8F if byte == 0xF4 else 0xBF
            else:
                raise UnicodeDecodeError("utf-8", bytes([byte]), 0, 1, "invalid start byte")
            return False
        if not self.low <= byte <= self.high:
            raise UnicodeDecodeError("utf-8", bytes([byte]), 0, 1, "invalid continuation byte")
        self.low, self.high = 0x80, 0xBF
        self.need -= 1
        return self.need == 0

    def feed(self, data: bytes) -> bytes:
        """Complete characters' bytes; the rest is held until its last byte comes."""
        if not self.held and data.isascii():
            return data
        for byte in data:
            self.held.append(byte)
            self.step(byte)
        tail = len(self.held) if self.need == 0 else self._tail()
        out = bytes(self.held[:tail])
        del self.held[:tail]
        return out

    def _tail(self) -> int:
        at = len(self.held) - 1
        while at >= 0 and self.held[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def finish(self) -> None:
        if self.need:
            raise UnicodeDecodeError("utf-8", bytes(self.held), 0, len(self.held), "unexpected end of data")


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = MAX_STATES, words: int = MAX_WORDS):
        self.machine = Transducer(ranks, states)
        self.split = Splitter(pattern)
        #: Of each distinct match, its ids as little-endian unsigned 32-bit integers.
        self.words = Memo(lambda word: array("I", self.machine.stream(word.encode("utf-8"))).tobytes(), words)

    def forget(self) -> None:
        """Gives back what can be built again, so that an idle worker holds no more than the merge table."""
        self.words.before = {}
        self.words.clear()
        self.machine.pairs.clear()
        self.machine._reset()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray, piece: int = 4096) -> Iterator[bytes]:
        """Complete characters' bytes, a piece of ids at a time."""
        machine, of = Utf8Machine(), self.machine.bytes_of.__getitem__
        for lo in range(0, len(ids), piece):
            yield machine.feed(b"".join(map(of, ids[lo : lo + piece].tolist())))
        machine.finish()


_codecs: dict[tuple, Codec] = {}


def codec(ranks_path: str, pattern: str, states: int = MAX_STATES, words: int = MAX_WORDS) -> Codec:
    """One codec for each worker process; its merge table serves all tasks."""
    key = (ranks_path, pattern, states, words)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(ranks_path), pattern, states, words)
    return _codecs[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = True, states: int = MAX_STATES, words: int = MAX_WORDS, give_back: bool = False) -> DataFrame:
    """docs without the text, plus ids (if kept), n_tokens, ids_sha256, decoded (if kept) and decoded_sha256.

    ``states`` and ``words`` bound a worker's memory (about 0.6 KB a state and 250 bytes a word), never the result.
    With ``give_back`` a worker empties its tables at a task's end, for later operators on the same executors.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def start():
        own = codec(ranks_path, pattern, states, words)

        def work(texts):
            out = {f.name: [] for f in fields}
            for t in texts:
                ids = own.encode(t or "")
                sha, pieces = hashlib.sha256(), []
                for piece in own.decode(ids):
                    sha.update(piece)
                    if keep_ids:
                        pieces.append(piece)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(sha.hexdigest())
                if keep_ids:
                    out["ids"].append(ids.astype("<i4"))
                    out["decoded"].append(b"".join(pieces).decode("utf-8"))
            return out

        if give_back:
            work.close = own.forget
        return work

    return map_texts(docs, text, T.StructType(fields), start)
