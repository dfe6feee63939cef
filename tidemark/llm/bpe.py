"""Byte-pair encoding: merge lists, the token counter, the streaming transducer and its decoder.

All vocabularies come from public tokenizer files whose path is a parameter. Pieces (pre-tokens) are independent of
each other, so each worker keeps a bounded table of what it has worked out for a piece.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np

from tidemark.llm.pieces import ByteSplit, PieceTable, WordSplit, segments

_NEVER = 1 << 40


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    hidden = (b for b in range(256) if b not in out)
    out.update({b: chr(0x100 + k) for k, b in enumerate(hidden)})
    return out


class Vocabulary:
    """What a tokenizer file says: ids, merges by rank, special tokens, the suffix of word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = pairs
        #: Rank of a pair of ids (left id in the high bits), and the id that a rank makes.
        self.ranks = {self.ids[a] << 20 | self.ids[b]: k for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_alphabet()
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.first = [self.ids[self.letters[b]] for b in range(256)]
        self.last = [self.ids[self.letters[b] + self.suffix] for b in range(256)]
        found = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.special_re = re.compile("|".join(found)) if found else None

    def symbols(self, piece: bytes) -> list[int]:
        """Ids of a piece's bytes, its last byte marked where the vocabulary marks word ends."""
        out = [self.first[b] for b in piece]
        if out and self.suffix:
            out[-1] = self.last[piece[-1]]
        return out

    def token_bytes(self, token: str) -> bytes:
        return bytes(self.bytes_of[c] for c in token)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Initial symbols minus merges. A heap holds adjacent pairs by (rank, place); a linked list holds the symbols.

    `rank_at` has the rank of the pair that starts at a place; a popped entry that disagrees with it is stale.
    No ids of tokens are emitted.
    """
    n = len(symbols)
    if n < 2:
        return n
    merges = sum(1 for _ in _merged(list(symbols), ranks, made))
    return n - merges


def _merged(text: list[int], ranks: dict[int, int], made: list[int]):
    """Merge in place, yielding once per merge; merged-away places hold -1."""
    n = len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = [ranks.get(a << 20 | b, -1) for a, b in zip(text, text[1:])] + [-1]
    heap = [r << 32 | k for k, r in enumerate(rank_at) if r >= 0]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        at, rank = entry & 0xFFFFFFFF, entry >> 32
        if rank_at[at] != rank:
            continue
        other = after[at]
        text[at], text[other] = made[rank], -1
        rank_at[other] = -1
        following = after[at] = after[other]
        rank_at[at] = -1
        if following < n:
            before[following] = at
            rank_at[at] = r = ranks.get(text[at] << 20 | text[following], -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | at)
        if (prior := before[at]) >= 0:
            rank_at[prior] = r = ranks.get(text[prior] << 20 | text[at], -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | prior)
        yield


def merge_long(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The merged symbols of a window of hundreds of symbols, by heap and linked list."""
    text = list(symbols)
    for _ in _merged(text, ranks, made):
        pass
    return [t for t in text if t >= 0]


def merge_short(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The same for a few symbols, where scanning the ranks of all pairs is quicker than a heap."""
    parts = list(symbols)
    at_rank = [ranks.get(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
    while at_rank and (low := min(at_rank)) != _NEVER:
        k = at_rank.index(low)
        parts[k : k + 2] = [made[low]]
        del at_rank[k]
        if k < len(at_rank):
            at_rank[k] = ranks.get(parts[k] << 20 | parts[k + 1], _NEVER)
        if k:
            at_rank[k - 1] = ranks.get(parts[k - 1] << 20 | parts[k], _NEVER)
    return parts


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """Bytes to the right that can still change a token.

    Run the merges of a prefix and of any longer text side by side, by rank. They first differ at the cut. The place
    where they begin to differ moves left only when a rule (u, v) joins across it: u ends there, and v, or what later
    grows from its start, begins there. The next such rule (u', v') has a higher rank, and u is v' or one of the
    tokens that v' was grown from at its left edge. So the longest sum of len(u) along such chains bounds the move;
    one pass over the rules by rank finds it.
    """
    left_of = {a + b: a for a, b in vocab.pairs}
    best: dict[str, int] = {}
    most = 0
    for u, v in vocab.pairs:
        far, token = 0, v
        while True:
            far = max(far, best.get(token, 0))
            if token not in left_of:
                break
            token = left_of[token]
        reach = len(u) + far
        best[u] = max(best.get(u, 0), reach)
        most = max(most, reach)
    return most


class Transducer:
    """Streaming encoder and decoder of a byte-level vocabulary.

    A piece is read through a window of fixed size. Tokens of a window are emitted once they end at least
    `lookahead` bytes before its right edge, or when the piece ends inside the window; the next window starts at the
    last emitted boundary. Memory is bound by the window, not by the piece.
    """

    def __init__(self, path: str, window: int = 0) -> None:
        self.vocab = vocabulary(path)
        self.lookahead = sufficient_lookahead(self.vocab)
        self.window = max(window, 2 * self.lookahead, 64)
        self.table = [b""] * (1 + max([*self.vocab.ids.values(), *self.vocab.special.values()]))
        for t, i in self.vocab.ids.items():
            self.table[i] = self.vocab.token_bytes(t)
        for t, i in self.vocab.special.items():
            self.table[i] = t.encode()
        self.split, self.known = ByteSplit(), PieceTable(self._learn, "<u4")

    def tokens(self, piece: bytes):
        """Yield lists of ids of a piece as they become stable."""
        start, n, vocab = 0, len(piece), self.vocab
        while start < n:
            end = min(n, start + self.window)
            symbols = vocab.symbols(piece[start:end])
            parts = (merge_short if len(symbols) <= 32 else merge_long)(symbols, vocab.ranks, vocab.made)
            if end == n:
                yield parts
                return
            stable, at, out = end - self.lookahead, start, []
            for token in parts:
                if at + len(self.table[token]) > stable:
                    break
                at += len(self.table[token])
                out.append(token)
            yield out
            start = at

    def _learn(self, keys: list[str | int]):
        """Ids of pieces; a number stands for itself."""
        for key in keys:
            if isinstance(key, int):
                yield key.to_bytes(4, "little")
            elif len(piece := key.encode()) <= 32:
                yield array("I", merge_short(self.vocab.symbols(piece), self.vocab.ranks, self.vocab.made)).tobytes()
            else:
                yield b"".join(array("I", ids).tobytes() for ids in self.tokens(piece))

    def _keys(self, text: str, plain: bool):
        """Lists of pieces, in turn; a special string is its id."""
        found, at = self.vocab.special_re, 0
        if not plain and found:
            for m in found.finditer(text):
                yield from map(self.split, segments(text[at : m.start()]))
                yield [self.vocab.special[m.group()]]
                at = m.end()
        yield from map(self.split, segments(text[at:] if at else text))

    def encode_all(self, texts: list[str], plain: bool = False) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Special strings in a text become their own ids, or, if plain, are text as any other.
        """
        ids, ends = self.known.gather([self._keys(t, plain) for t in texts])
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes, step: int = 1 << 16) -> str:
        """Ids to text, `step` ids at a time; between steps only the bytes of an unfinished character are held."""
        machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        view = memoryview(ids).cast("I")
        for at in range(0, len(view), step):
            out.append(machine.decode(b"".join(map(self.table.__getitem__, view[at : at + step]))))
        out.append(machine.decode(b"", True))
        return "".join(out)


class WordPieces:
    """Sums of a number for each piece of the word-end vocabulary; value(piece bytes) is worked out once for a piece."""

    def __init__(self, path: str, value) -> None:
        self.vocab, self.split, self.value = vocabulary(path), WordSplit(), value
        self.known = PieceTable(self._learn, "<u4")

    def _learn(self, keys: list[str | int]):
        """A number stands for itself."""
        for key in keys:
            yield (key if isinstance(key, int) else self.value(key.encode())).to_bytes(4, "little")

    def _keys(self, text: str, special: int):
        found, at = self.vocab.special_re, 0
        if found:
            for m in found.finditer(text):
                yield from map(self.split, segments(text[at : m.start()]))
                yield [special]
                at = m.end()
        yield from map(self.split, segments(text[at:] if at else text))

    def totals(self, texts: list[str], special: int) -> np.ndarray:
        """The sum over each text; every special string counts as `special`."""
        values, ends = self.known.gather([self._keys(t, special) for t in texts])
        before = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=before[1:])
        return np.diff(before[ends], prepend=0)
