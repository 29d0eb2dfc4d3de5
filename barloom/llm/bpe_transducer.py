"""Byte-level BPE as a transducer that is determinised while it runs, and streaming UTF-8 decoding.

A token sequence is the BPE encoding of its bytes exactly when each adjacent
pair of tokens is the encoding of the pair's own bytes (merges act on
neighbours only).  So the encoder is a nondeterministic transducer: walk a
token's bytes in a trie, write the token, and start the next one if the pair
fits.  Its determinised form keeps, after each byte, all hypotheses about
where the token in progress began, each with the token before it.  A
hypothesis dies when the trie has no such token, so there are at most as many
as the longest token has bytes.  Each arc writes the one token that ends at
its byte in the encoding of all bytes so far; read from the end, the tokens
that touch are the encoding.  States and arcs are made when first met, and
hold no tokens that wait to be written, so texts with the same last bytes and
tokens share them.  New words hardly share arcs: many of them take the subset
step together, byte by byte, their hypotheses rows of arrays.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what a task remembers: characters of encoded strings between spaces (and of pieces), and arcs of the transducer.
CHUNK_CHARS, ARCS = 4_000_000, 400_000
#: Characters of texts that are cut together, and of what is encoded side by side: words, bytes of a piece, and pairs of tokens remembered.
BLOCK_CHARS, SIDE_WORDS, SIDE_BYTES, SIDE_PAIRS = 2_000_000, 100_000, 48, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


NO_CHILD: dict = {}


class Node:
    """Node of the trie over token bytes; ``token`` is -1 inside tokens."""

    __slots__ = ("child", "token")

    def __init__(self):
        self.child, self.token = NO_CHILD, -1


class Shape:
    """What the hypotheses of many states have in common: their nodes, with the bytes begun; they differ in the tokens before."""

    __slots__ = ("begun", "nodes", "steps", "states")

    def __init__(self, begun: tuple[int, ...], nodes: tuple[Node, ...]):
        self.begun, self.nodes = begun, nodes
        self.steps: dict[int, tuple[Shape, tuple, tuple]] = {}  # byte to (next shape, hypotheses that go on, tokens that may end)
        self.states: dict[tuple[int, ...], State] = {}  # by the tokens before


class State(dict):
    """Arcs, byte to (next state, token that ends at the byte, its length), made when first asked for."""

    __slots__ = ("fst", "shape", "before")

    def __init__(self, fst: Transducer, shape: Shape, before: tuple[int, ...]):
        self.fst, self.shape, self.before = fst, shape, before

    def __missing__(self, byte: int) -> tuple[State, int, int]:
        return self.fst.arc(self, byte)


class Transducer:
    """Encoder of single pieces by lazily made states."""

    def __init__(self, ranks: dict[bytes, int], arcs: int = ARCS):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.ranks, self.most = ranks, arcs
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.root = Node()
        for token, i in ranks.items():
            node = self.root
            for b in token:
                if b not in node.child:
                    if node.child is NO_CHILD:
                        node.child = {}
                    node.child[b] = Node()
                node = node.child[b]
            node.token = i
        self.pairs: dict[int, bool] = {}
        self.own: dict[int, bool] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.shapes: dict[tuple[Node, ...], Shape] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first; they refer to each other, and nothing else would free them."""
        for shape in self.shapes.values():
            for state in shape.states.values():
                state.clear()
            shape.states.clear()
            shape.steps.clear()
        shape = Shape((0,), (self.root,))
        self.shapes = {shape.nodes: shape}
        self.start = shape.states[(-1,)] = State(self, shape, (-1,))
        self.made = 0

    @property
    def known(self) -> Iterator[tuple[tuple[int, int, Node], ...]]:
        """The hypotheses of every state met: bytes begun, token before, node."""
        return (tuple(zip(s.begun, last, s.nodes)) for s in self.shapes.values() for last in s.states)

    def merged(self, data: bytes) -> list[int]:
        """Encoding of a short string by the definition: the lowest rank merges first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of ``token`` joins (a byte: itself twice)."""
        found = self.parts.get(token)
        if found is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.parts[token] = (parts[0], parts[-1])
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding (-1: the start).

        Only the right edge of ``left`` and the left edge of ``right`` could
        merge across.  Both edges grow in the order of their merges; the pair
        fits if each of those merges comes before one across would.
        """
        if left < 0:
            found = self.own.get(right)
            if found is None:
                found = self.own[right] = self.merged(self.bytes_of[right]) == [right]
            return found
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) > self.most:
            self.pairs.clear()
        if not (self.fits(-1, left) and self.fits(-1, right)):
            return False
        rank = self.ranks
        found, a, b = True, self.edge(left, 1), self.edge(right, 0)
        i, j = len(a) - 1, len(b) - 1
        while True:
            across = rank.get(a[i][0] + b[j][0])
            # a[i][1] is the rank of the merge that takes a[i] into a[i - 1]
            if across is not None and across < a[i][1] and across <= b[j][1]:
                found = False
                break
            if a[i][1] <= b[j][1]:
                if not i:
                    break
                i -= 1
            else:
                j -= 1
        self.pairs[key] = found
        return found

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """From a token down to its outermost byte on one side: the part, and the rank of the merge that takes it up."""
        found = self.edges[side].get(token)
        if found is None:
            part, above = self.bytes_of[token], 1 << 60
            found = [(part, above)]
            while len(part) > 1:
                above = self.ranks[part]
                part = self.halves(part)[side]
                found.append((part, above))
            self.edges[side][token] = found
        return found

    def step(self, shape: Shape, byte: int) -> tuple[Shape, tuple, tuple]:
        """Where the nodes of a shape go, whatever the tokens before: (next shape, hypotheses that go on, tokens that may end)."""
        begun, nodes, stay, ends = [], [], [], []
        for i, node in enumerate(shape.nodes):
            on = node.child.get(byte)
            if on is None:
                continue
            if on.token >= 0:
                ends.append((i, on.token, shape.begun[i] + 1))
            if on.child:  # a token that no longer one begins with ends here
                stay.append(i)
                begun.append(shape.begun[i] + 1)
                nodes.append(on)
        key = (*nodes, self.root)
        target = self.shapes.get(key)
        if target is None:
            target = self.shapes[key] = Shape((*begun, 0), key)
        out = shape.steps[byte] = target, tuple(stay), tuple(ends)
        return out

    def arc(self, state: State, byte: int) -> tuple[State, int, int]:
        """(next state, token that ends here, its length) of one byte: the subset step."""
        shape, before = state.shape, state.before
        target, stay, ends = shape.steps.get(byte) or self.step(shape, byte)
        pairs = self.pairs
        for i, token, length in ends:
            last = before[i]
            found = pairs.get(last << 32 | token) if last >= 0 else None
            if self.fits(last, token) if found is None else found:
                break
        else:
            raise AssertionError("every string of bytes has an encoding")
        key = (*[before[i] for i in stay], token)
        to = target.states.get(key)
        if to is None:
            to = target.states[key] = State(self, target, key)
        out = state[byte] = to, token, length
        self.made += 1
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.made > self.most:
            self.clear()
        arc = self.start, -1, 0
        path = [arc := arc[0][byte] for byte in piece]
        out, at = [], len(piece) - 1
        while at >= 0:
            _, token, length = path[at]
            out.append(token)
            at -= length
        out.reverse()
        return out


class Pairs:
    """Numbers by pairs of numbers, looked up for arrays of pairs: open addressing, a quarter full at most."""

    def __init__(self, left: Sequence[int], right: Sequence[int], value: Sequence[int]):
        key, value = self.key(np.array(left, np.int64), np.array(right, np.int64)), np.array(value, np.int32)
        self.bits = (4 * len(key)).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, rest = self.slot(key, self.bits), np.arange(len(key))
        while len(rest):
            free = self.keys[slot[rest]] < 0
            self.keys[slot[rest[free]]] = key[rest[free]]
            won = self.keys[slot[rest]] == key[rest]
            self.values[slot[rest[won]]] = value[rest[won]]
            rest = rest[~won]
            slot[rest] = slot[rest] + 1 & len(self.keys) - 1

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    @staticmethod
    def slot(key: np.ndarray, bits: int) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray, default: int) -> np.ndarray:
        key = self.key(left, right)
        slot = self.slot(key, self.bits)
        found = self.keys[slot]
        out = np.where(hit := found == key, self.values[slot], np.int32(default))
        rest = np.flatnonzero(~hit & (found >= 0))
        while len(rest):
            slot[rest] = slot[rest] + 1 & len(self.keys) - 1
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class SideBySide:
    """The hypotheses of many pieces at once: each byte is one step of all of them on arrays."""

    TOP = (1 << 31) - 1

    def __init__(self, fst: Transducer):
        nodes, edges = [fst.root], []
        for i, node in enumerate(nodes):
            for byte, child in node.child.items():
                edges.append((i, byte, len(nodes)))
                nodes.append(child)
        self.next = Pairs(*zip(*edges, strict=True))
        self.ends = np.array([n.token for n in nodes], np.int32)
        self.inner = np.array([bool(n.child) for n in nodes])
        size = max(fst.bytes_of) + 1
        self.length, self.own = np.zeros(size, np.int32), np.zeros(size, bool)
        half, merges = {}, []
        for token, data in fst.bytes_of.items():
            a, b = fst.halves(data)
            half[token] = fst.ranks[a], fst.ranks[b]
            self.length[token] = len(data)
            self.own[token] = len(data) == 1 or a + b == data
            merges += [(fst.ranks[data[:i]], fst.ranks[data[i:]], token) for i in range(1, len(data)) if data[:i] in fst.ranks and data[i:] in fst.ranks]
        self.merge = Pairs(*zip(*merges, strict=True)) if merges else None
        # from the byte at a token's edge up to the token, a part after the other, then TOP
        self.climb, self.foot = [], []
        for side in (0, 1):
            climb, foot = [], np.zeros(size, np.int64)
            for token in fst.bytes_of:
                chain = [token]
                while self.length[chain[-1]] > 1:
                    chain.append(half[chain[-1]][side])
                foot[token] = len(climb)
                climb += [*reversed(chain), self.TOP]
            self.climb.append(np.array(climb, np.int32))
            self.foot.append(foot)
        self.met, self.met_fit = np.full(SIDE_PAIRS, -1, np.int64), np.zeros(SIDE_PAIRS, bool)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Transducer.fits`` for arrays; the pairs last met are remembered, one for each slot."""
        out = self.own[right]
        at = np.flatnonzero(left >= 0)
        key = Pairs.key(left[at], right[at])
        slot = Pairs.slot(key, SIDE_PAIRS.bit_length() - 1)
        out[at] = self.met_fit[slot]
        new = np.flatnonzero(self.met[slot] != key)
        key, first, back = np.unique(key[new], return_index=True, return_inverse=True)
        some = at[new[first]]
        found = self._fits(left[some], right[some])
        out[at[new]] = found[back]
        # of the pairs of one slot one is kept, with its own answer
        slot = slot[new[first]]
        self.met[slot] = key
        mine = self.met[slot] == key
        self.met_fit[slot[mine]] = found[mine]
        return out

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self.own[left] & self.own[right]
        if self.merge is None:
            return out
        at = np.flatnonzero(out)
        up, down = self.climb[1], self.climb[0]
        i, j = self.foot[1][left[at]], self.foot[0][right[at]]
        while len(at):
            above, over = up[i + 1], down[j + 1]
            across = self.merge.get(up[i], down[j], self.TOP)
            bad = (across < above) & (across <= over)
            out[at[bad]] = False
            on = np.flatnonzero(~bad & ((above < self.TOP) | (over < self.TOP)))
            at, left_goes = at[on], above[on] <= over[on]
            i, j = i[on] + left_goes, j[on] + ~left_goes
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces ``data[start : start + size]``, and where each piece's begin (with the end of all)."""
        order = np.argsort(-size, kind="stable")  # pieces that have a byte more stand first
        start, size, n = start[order], size[order], len(order)
        most = int(size[0]) if n else 0
        last = np.full((most + 1, n), -1, np.int32)  # the token that ends before a byte
        piece = begin = node = np.zeros(0, np.int64)
        for at in range(most):
            live = int(np.searchsorted(-size, -at, "left"))
            keep = np.flatnonzero(piece < live)
            piece = np.concatenate([piece[keep], np.arange(live)])
            begin = np.concatenate([begin[keep], np.full(live, at)])
            node = np.concatenate([node[keep], np.zeros(live, np.int64)])
            node = self.next.get(node, data[start[piece] + at], -1)
            token = self.ends[node]
            can = np.flatnonzero((node >= 0) & (token >= 0))
            of, since, token = piece[can], begin[can], token[can]
            fit = np.flatnonzero(self.fits(last[since, of], token))
            if len(fit) != live:
                raise AssertionError("every string of bytes has one encoding")
            last[at + 1, of[fit]] = token[fit]
            whole = np.flatnonzero((since == 0) & (size[of] == at + 1))  # a piece that is a token is that token
            last[at + 1, of[whole]] = token[whole]
            on = np.flatnonzero((node >= 0) & self.inner[node])
            piece, begin, node = piece[on], begin[on], node[on]
        # from the end, the tokens that touch
        found, left, who = [], size.copy(), np.arange(n)
        count = np.zeros(n, np.int64)
        while len(who):
            token = last[left[who], who]
            found.append((who, token))
            count[who] += 1
            left[who] -= self.length[token]
            who = who[left[who] > 0]
        begins = np.zeros(n + 1, np.int64)
        begins[order + 1] = count
        begins = np.cumsum(begins)
        out = np.zeros(begins[-1], np.int32)
        for k, (who, token) in enumerate(found):
            out[begins[order[who] + 1] - 1 - k] = token
        return out, begins


class Utf8Decoder:
    """Incremental UTF-8: states count the bytes a character still needs and bound its next byte.

    Malformed parts become U+FFFD, one for each maximal prefix of a character.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.whole: dict[int, str] = {}  # tokens that are complete characters
        for i, t in bytes_of.items():
            self.reset()
            text = self.feed(t)
            if not self.need and "�" not in text:
                self.whole[i] = text
        self.reset()

    def reset(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        """Text completed by ``data``."""
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                # no overlong forms, surrogates or code points over U+10FFFF
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What is left at the end: a character that never got complete."""
        left = "�" if self.need else ""
        self.reset()
        return left

    def stream(self, ids: Iterable[int], block: int = 64) -> Iterator[str]:
        """Text as the tokens come, in blocks; then what was left."""
        ids = iter(ids)
        while some := list(islice(ids, block)):
            parts = list(map(self.whole.get, some)) if not self.need else [None]
            if None in parts:  # some token ends inside a character
                parts = []
                for i in some:
                    text = self.whole.get(i) if not self.need else None
                    parts.append(self.feed(self.bytes_of[i]) if text is None else text)
            yield "".join(parts)
        yield self.end()


#: A piece, or what stands between two spaces: the decimals of its tokens joined by spaces, and what they decode to.
Chunk = tuple[str, str]


class Codec:
    """Whole texts: pieces by the split pattern; what was encoded and decoded is remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk_chars: int = CHUNK_CHARS):
        self.fst = Transducer(ranks)
        self.decoder = Utf8Decoder(self.fst.bytes_of)
        self.decimals = {i: str(i) for i in self.fst.bytes_of}
        self.split = regex.compile(pattern)
        self.most = chunk_chars
        self.side: SideBySide | None = None
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, Chunk] = {}  # from the begin of a text
        self.later: dict[str, Chunk] = {}  # after a space
        self.pieces: dict[str, Chunk] = {}
        self.age()

    def age(self) -> None:
        """Start a new generation: what the last one met is taken over when it is met again, what is older is forgotten."""
        self.held = 0
        self.old_later, self.old_pieces = self.later, self.pieces
        self.first, self.later, self.pieces = {}, {}, {}

    def _piece(self, piece: str) -> Chunk:
        found = self.old_pieces.get(piece)
        if found is not None:
            self.pieces[piece] = found
            self.held += len(piece)
            return found
        ids = tuple(self.fst.encode(piece.encode()))
        whole, decimals = self.decoder.whole, self.decimals
        try:
            text = "".join(map(whole.__getitem__, ids))
        except KeyError:  # some token ends inside a character
            text = self.decode(ids)
        found = " ".join(map(decimals.__getitem__, ids)), text
        if len(piece) < 256:
            self.pieces[piece] = found
            self.held += len(piece)
        return found

    def _chunk(self, pieces: list[str]) -> Chunk:
        known = self.pieces
        found = [known.get(p) or self._piece(p) for p in pieces]
        if len(found) == 1:
            return found[0]
        return " ".join([f[0] for f in found]), "".join([f[1] for f in found])

    def _learn(self, parts: list[str]) -> bool:
        """Remember the parts between spaces; False if the spaces do not start pieces, so that the text cannot be cut at them."""
        later, old = self.later, self.old_later
        new = [p for p in set(islice(parts, 1, None)) if p not in later]
        if old:
            rest = []
            for p in new:
                found = old.get(p)
                if found is None:
                    rest.append(p)
                else:
                    later[p] = found
                    self.held += len(p)
            new = rest
        # white space next to a space belongs to its piece
        for p in (parts[0], *new):
            if not p or p[0].isspace() or p[-1].isspace():
                return False
        if new:
            self._split(new)
        if parts[0] not in self.first:
            self.first[parts[0]] = self._chunk(self.split.findall(parts[0]))
            self.held += len(parts[0])
        return True

    def _split(self, new: list[str]) -> None:
        """Encode and remember parts that follow a space, split in one go: only the first piece of a part begins with a space."""
        pieces, later, known = self.split.findall(" " + " ".join(new)), self.later, self.pieces
        begins = [i for i, p in enumerate(pieces) if p[0] == " "]
        for p, i, end in zip(new, begins, chain(islice(begins, 1, None), [len(pieces)]), strict=True):
            later[p] = known.get(pieces[i]) or self._piece(pieces[i]) if end == i + 1 else self._chunk(pieces[i:end])
        self.held += sum(map(len, new))

    def learn(self, texts: Sequence[str]) -> list[list[str]]:
        """The texts cut at their spaces; what stands between is remembered, the new of all texts encoded side by side."""
        if 2 * self.held > self.most:
            self.age()
        cut, later, old, new = [text.split(" ") for text in texts], self.later, self.old_later, set()
        for parts in cut:
            new.update(islice(parts, 1, None))
            p = parts[0]
            if p not in self.first and p and p == p.strip():
                self.first[p] = self._chunk(self.split.findall(p))
                self.held += len(p)
        new.difference_update(later)
        back = [p for p in new if p in old]
        new.difference_update(back)
        later.update(zip(back, map(old.__getitem__, back), strict=True))
        self.held += sum(map(len, back))
        words = [p for p in new if p and p == p.strip()]
        if len(words) >= 1000:
            for i in range(0, len(words), SIDE_WORDS):
                self._side(words[i : i + SIDE_WORDS])
        return cut

    def _side(self, words: list[str]) -> None:
        """``_split`` on arrays."""
        if self.side is None:
            self.side = SideBySide(self.fst)
            every = range(len(self.side.own))
            self.spelt = pa.array([self.fst.bytes_of.get(i, b"") for i in every], pa.large_binary())
            self.digits = pa.array([self.decimals.get(i, "") + end for end in (" ", "\n") for i in every], pa.large_string())
        text = " ".join(["", *words])
        pieces = self.split.findall(text)
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        if len(first) != len(words):
            raise AssertionError("a space starts a piece")
        data = np.frombuffer(text.encode(), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        start = chars[np.cumsum(np.fromiter(chain([0], map(len, pieces)), np.int64, len(pieces) + 1))]
        start, size = start[:-1], np.diff(start)
        # pieces too long to go with the others
        some, alone = np.flatnonzero(size <= SIDE_BYTES), np.flatnonzero(size > SIDE_BYTES)
        ids, begins = self.side.encode(data, start[some], size[some])
        if len(alone):
            parts = dict(zip(some.tolist(), np.split(ids, begins[1:-1]), strict=True)) if len(some) else {}
            parts |= {i: np.array(self.fst.encode(pieces[i].encode()), np.int32) for i in alone.tolist()}
            ids, begins = np.concatenate([parts[i] for i in range(len(pieces))]), np.cumsum([0, *(len(parts[i]) for i in range(len(pieces)))])
        ends = np.zeros(len(ids), bool)
        ends[np.append(begins[first[1:]], len(ids)) - 1] = True
        # the parts hold no space, and spell whole characters
        decoded = self.spelt.take(pa.array(ids)).buffers()[2].to_pybytes().decode().split(" ")
        digits = self.digits.take(pa.array(ids + ends * len(self.side.own))).buffers()[2].to_pybytes().decode().split("\n")
        self.later.update(zip(words, zip(digits[:-1], [" " + x for x in decoded[1:]], strict=True), strict=True))
        self.held += sum(map(len, words))

    def chunks(self, text: str) -> list[Chunk]:
        """The text in chunks that are encoded and decoded by themselves.

        A space between two characters that are not white space starts a
        piece, so what stands between such spaces is encoded, and remembered,
        by itself.  Its tokens spell whole characters, so its decoding ends
        where the next one's begins.
        """
        if 2 * self.held > self.most:  # two generations
            self.age()
        return self._found(text, text.split(" "))

    def _found(self, text: str, parts: list[str]) -> list[Chunk]:
        if len(parts) == 1:
            return [self._chunk(self.split.findall(text))]
        try:
            found = [self.first[parts[0]]]
            found += map(self.later.__getitem__, islice(parts, 1, None))
            return found
        except KeyError:
            if not self._learn(parts):
                return [self._chunk(self.split.findall(text))]
        return [self.first[parts[0]], *map(self.later.__getitem__, islice(parts, 1, None))]

    def encode(self, text: str) -> tuple[Sequence[int], str]:
        """Tokens, and their decimals joined by spaces."""
        digits = " ".join([c[0] for c in self.chunks(text)])
        return list(map(int, digits.split())), digits

    def encode_all(self, texts: Sequence[str]) -> Iterator[tuple[str, str]]:
        """For each text the decimals of its tokens joined by spaces, and what they decode to."""
        for text, parts in zip(texts, self.learn(texts), strict=True):
            digits, decoded = zip(*self._found(text, parts), strict=True)
            yield " ".join(digits), "".join(decoded)

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.decoder.stream(ids))


def _blocks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in blocks of ``BLOCK_CHARS`` or little more."""
    texts, size = [], 0
    for text in column:
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= BLOCK_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_documents(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``) of every whole text.

    ``vocabulary`` is the path of a rank file; its ranks are broadcast (a fixed size).
    Null texts count as empty; special tokens are ordinary text; very long texts
    are taken whole; repeated rows are each encoded; other columns are ignored;
    an empty table gives no rows.
    """
    table = read_ranks(vocabulary)
    ranks = df.sparkSession.sparkContext.broadcast(table)
    name = hashlib.sha256(repr(sorted(table.items())).encode()).hexdigest()
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a Python worker runs many tasks: what one of them learnt serves the next
        kept = sys.modules.setdefault("_llm_codecs", ModuleType("_llm_codecs")).__dict__
        if kept.get("key") != (name, pattern):
            kept.update(key=(name, pattern), codec=Codec(ranks.value, pattern))
        codec = kept["codec"]
        collecting = gc.isenabled()
        gc.disable()  # millions of small tuples, no cycles
        try:
            for batch in batches:
                counts, hashes, decoded, lists = [], [], [], []
                for digits, text in chain.from_iterable(map(codec.encode_all, _blocks(batch.column(1)))):
                    counts.append(digits.count(" ") + (digits != ""))
                    hashes.append(hashlib.sha256(digits.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        lists.append(list(map(int, digits.split())))
                out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out, names = [*out, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)
        finally:
            if collecting:
                gc.enable()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each list of token ids (null: null), decoded as a stream."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Utf8Decoder({i: t for t, i in ranks.value.items()})
        for batch in batches:
            texts = [None if ids is None else "".join(decoder.stream(ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
