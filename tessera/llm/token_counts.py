"""Token counts by finite-state tokenizer compilation.

The byte-level BPE tokenizer of a ``tokenizers`` JSON file is compiled into two deterministic machines.

* The pre-tokenizer's language is strictly local: whether a piece starts at a character depends on its class and on at
  most four characters around it. It is evaluated as array operations over whole batches. Classes of characters are
  learned from the library's own pre-tokenizer, once for each distinct character.
* Within a piece, BPE is a transducer over bytes. A sequence of tokens is the encoding of its bytes exactly if each two
  neighbours encode to themselves, so after each byte exactly one token can be last. A state holds, for every earlier
  position from which a token may still be growing, the token that ends there, the place in the tokens' trie, and the
  count of tokens there relative to the count now. Equal sets are one state; states and transitions are made when first
  met and shared by all texts of a worker. A transition carries the change of the number of tokens if the piece ended
  there.

Texts are cut into chunks that run in lockstep. A chunk's map from entry state to (exit state, count) is constant
behind its first piece start; the part before it (its head) is the only one that depends on the entry. Chunks without a
start lie within a piece that is longer than a chunk. Their maps are kept for the states that can enter: first the
piece's start state, then whatever the chunk before leaves, until none is new; as exits depend on the last bytes only,
save in rare cases, that is two states or so. The maps then compose pairwise in a parallel prefix scan, by pointer
doubling: the whole piece is one map after log2(chunks) rounds. Then all heads run in lockstep.

Special tokens inside texts count as one token each, as is the library's default. Null and empty texts have none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = 256
#: Characters that are laid out at once; a longer text makes a batch of its own.
BATCH_CHARS = 4_000_000
ROOT, IDLE = 0, 1
#: Column of the table for what lies behind a text's end.
PAD = 0
#: States after which the table is emptied, between batches; it fills again with those that are met.
MOST_STATES = 250_000
#: A table entry is (state << SHIFT) + change + BIAS; below 0: not made yet.
SHIFT, BIAS = 6, 32
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Machine:
    """The compiled tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = byte_alphabet()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        vocab = {b: i for i, b in self.bytes_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, text in sorted(self.bytes_of.items()):
            if self.encode(text) != [token]:
                continue  # no text encodes to it
            node = 0
            for b in text:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = token
        self.follows: dict[tuple[int, int], bool] = {}
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.reset()

    def encode(self, text: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until there is none."""
        tokens = [self.single[b] for b in text]
        while len(tokens) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            tokens[i : i + 2] = [self.ranks[tokens[i], tokens[i + 1]][1]]
        return tokens

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            known = self.follows[a, b] = self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def reset(self) -> None:
        """Only the start and the idle state; others come back as they are met."""
        self.states: list[tuple] = [((-1, 0, 0),), ()]
        self.number = {self.states[0]: ROOT}
        self.bytes_met: list[int] = []  # by column less one
        self.column = np.zeros(256, np.int16)
        self.table = np.full((1024, 64), -1, np.int32)
        self._idle(0)

    def _idle(self, row: int) -> None:
        self.table[row:, PAD] = (IDLE << SHIFT) + BIAS
        self.table[IDLE] = (IDLE << SHIFT) + BIAS

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table's columns of bytes; bytes not met before get one."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column == 0))
        for b in new.tolist():
            self.bytes_met.append(b)
            self.column[b] = len(self.bytes_met)
        if len(self.bytes_met) >= self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full((len(self.table), len(self.bytes_met) + 32 - self.table.shape[1]), -1, np.int32)], axis=1)
            self._idle(0)
        return self.column[data]

    def step(self, state: int, column: int) -> None:
        """Fill one transition."""
        byte = self.bytes_met[column - 1]
        grown, last, delta = [], None, 0
        for before, node, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if last is None and token >= 0 and (before < 0 or self.may_follow(before, token)):
                last, delta = token, count + 1
            if self.children[child]:
                grown.append((before, child, count))
        key = tuple(sorted({(b, n, c - delta) for b, n, c in grown} | {(last, 0, 0)}))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table[: max(1024, to // 2)], -1)])
                self._idle(to)
        self.table[state, column] = (to << SHIFT) + delta + BIAS

    def run(self, state: np.ndarray, symbols: np.ndarray, starts: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of lanes in lockstep; symbols and starts have a row for each step, ``length`` ends lanes early."""
        counts, width = np.zeros(len(state), np.int32), self.table.shape[1]
        for t in range(len(symbols)):
            at = np.where(starts[t], ROOT, state) * width + symbols[t]
            if length is not None:
                at = np.where(length > t, at, IDLE * width)
            got = self.table.reshape(-1).take(at)
            if got.min() < 0:
                for x in np.unique(at[got < 0]).tolist():
                    self.step(x // width, x % width)
                got = self.table.reshape(-1).take(at)
            counts += (got & ((1 << SHIFT) - 1)) - BIAS
            to = got >> SHIFT
            state = to if length is None else np.where(length > t, to, state)
        return state, counts

    def heads(self, entry: np.ndarray, symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of the first ``left`` bytes of chunks, no piece starting there, from their entry states."""
        most = int(left.max(initial=0))
        return self.run(entry, np.ascontiguousarray(symbols[:, :most].T), np.zeros((most, 1), bool), left)

    def scan(self, whole: np.ndarray, through: np.ndarray, leaves: np.ndarray, counts: np.ndarray, symbols: np.ndarray, left: np.ndarray) -> None:
        """Compose the maps of neighbouring chunks without a start: the first of each row of them gets the count of all, the last its exit state.

        A map is a set of entries (chunk, state) with exit and count; an entry leads to that of the next chunk by its exit.
        """
        if not len(whole):
            return
        opens = ~through[whole - 1]
        follows = np.append(through[1:], False)
        begin = whole[opens] << 32 | leaves[whole[opens] - 1]
        known, exits, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.unique(np.concatenate([begin, whole[~opens] << 32 | ROOT]))
        while len(new):
            lane, entry = new >> 32, new & 0xFFFFFFFF
            left_by, count = self.heads(entry, symbols[lane], left[lane])
            known, exits, sums = np.concatenate([known, new]), np.concatenate([exits, left_by]), np.concatenate([sums, count])
            on = follows[lane]
            new = np.setdiff1d((lane[on] + 1) << 32 | left_by[on], known)
        order = np.argsort(known)
        known, exits, sums = known[order], exits[order], np.append(sums[order], 0)
        n, lane = len(known), known >> 32
        jump = np.append(np.where(follows[lane], np.searchsorted(known, (lane + 1) << 32 | exits), n), n)
        last, self.rounds = np.arange(n + 1), 0
        while (jump < n).any():
            sums, last, jump = sums + sums[jump], np.where(jump < n, last[jump], last), jump[jump]
            self.rounds += 1
        at = np.searchsorted(known, begin)
        counts[whole] = 0
        counts[whole[opens]] = sums[at]
        leaves[lane[last[at]]] = exits[last[at]]

    def kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                c = chr(p)
                one = lambda x: len(self.pre.pre_tokenize_str(x)) == 1
                self.kind[p] = LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else SPACE
            kinds = self.kind[points]
        return kinds

    def piece_starts(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where pieces start; first and last mark the ends of each text."""
        n = len(points)
        kind = self.kinds(points)
        space = kind == SPACE
        before = np.empty(n, np.uint8)
        before[0], before[1:] = UNKNOWN, kind[:-1]
        before[first] = UNKNOWN
        blank = np.zeros(n, bool)  # the character before is U+0020, in the same text
        blank[1:] = points[:-1] == 0x20
        blank[first] = False
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = ~space[1:]
        solid_next[last] = False
        starts = np.where(space, (before != SPACE) | solid_next, (before != kind) & ~blank)
        starts[first] = True
        # Contractions: an apostrophe at which a piece starts, followed by one of s t m d, re ve ll.
        marks = np.flatnonzero(starts & (points == 0x27))
        if len(marks):
            end_of = np.cumsum(first)  # number of the text
            follow = lambda k: np.where((marks + k < n) & (end_of[np.minimum(marks + k, n - 1)] == end_of[marks]), points[np.minimum(marks + k, n - 1)], 0)
            a, b = follow(1), follow(2)
            short = np.isin(a, [ord(c) for c in "stmd"])
            long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for found, size in ((marks[short], 2), (marks[long], 3)):
                starts[found + 1] = False
                after = found + size
                same = after < n
                same[same] = end_of[after[same]] == end_of[found[same]]
                starts[after[same & ~space[np.minimum(after, n - 1)]]] = True
        return starts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        batch = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(texts)]
        return np.concatenate([self._count(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]) if texts else np.zeros(0, np.int64)

    def _count(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.special is not None and (found := self.special.findall(t)):
                total[i] += len(found)
                for part in self.special.split(t):
                    if part:
                        parts.append(part)
                        owner.append(i)
            else:
                parts.append(t)
                owner.append(i)
        if not parts:
            return total
        if len(self.states) > MOST_STATES:
            self.reset()
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        chars = np.array([len(p) for p in parts])
        ends = np.cumsum(chars)
        first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
        first[ends - chars], last[ends - 1] = True, True
        data = np.frombuffer(whole.encode("utf-8"), np.uint8)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        starts = np.zeros(len(data), bool)
        starts[heads] = self.piece_starts(points, first, last)
        begin = heads[ends - chars]
        size = np.diff(np.append(begin, len(data)))
        lanes = -(-size // LANE)
        first_lane = np.cumsum(lanes) - lanes
        symbols = np.full(int(lanes.sum()) * LANE, PAD, np.int16)
        flags = np.zeros(len(symbols), bool)
        place = np.arange(len(data)) + np.repeat(first_lane * LANE - begin, size)
        symbols[place], flags[place] = self.columns(data), starts
        symbols, flags = symbols.reshape(-1, LANE), flags.reshape(-1, LANE)
        n = len(symbols)
        leaves, counts = self.run(np.full(n, IDLE, np.int64), np.ascontiguousarray(symbols.T), np.ascontiguousarray(flags.T))
        through = ~flags.any(axis=1)
        head = np.where(through, LANE, flags.argmax(axis=1))
        left = np.where(through, (symbols != PAD).sum(axis=1), head)  # bytes that wait for the entry state
        self.scan(np.flatnonzero(through), through, leaves, counts, symbols, left)
        rest = np.flatnonzero(~through & (left > 0))
        counts[rest] += self.heads(leaves[rest - 1], symbols[rest], left[rest])[1]
        np.add.at(total, np.repeat(owner, lanes), counts)
        return total


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def token_count(text: Column, vocabulary: str) -> Column:
    """The number of tokens of a text; ``vocabulary`` is the path of a tokenizer file that every executor has."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = machine(vocabulary)
        for texts in batches:
            yield pd.Series(compiled.count(list(texts)))

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with its number of tokens."""
    return docs.withColumn(name, token_count(F.col(text), vocabulary))
