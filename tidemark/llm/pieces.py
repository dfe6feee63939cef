"""Pieces (pre-tokens) of texts, and a table of what is known of each piece, filled and read a batch at a time."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex

#: Fixed pattern of the byte-level vocabularies, as published with them.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed pattern of the word-end vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters below this one are near: they stand for themselves under NFC, and their lower case is one near character.
NEAR = 0x180
#: Far characters: those beyond, the dotted I (two characters in lower case), and controls that only one library calls space.
FAR = re.compile("[\x1c-\x1fİƀ-\U0010ffff]")
#: Characters of a text that are split at a time.
SEGMENT = 1 << 16
#: Pieces, and characters in them, that a worker keeps before its table starts anew.
TABLE_PIECES, TABLE_CHARS = 500_000, 32 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _near(pattern: str) -> re.Pattern:
    """The same pattern for near texts, with the classes of letters and numbers written out."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    inside = re.sub(r"(\[\^?(?:\\s)?)((?:\\p\{[LN]\})+)\]", lambda m: m[1] + m[2].replace(r"\p{L}", letters).replace(r"\p{N}", numbers) + "]", pattern)
    return re.compile(inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


def segments(text: str) -> Iterator[str]:
    """Cut a long text before single blanks, where a piece of either pattern can begin but none can reach across."""
    at = 0
    while len(text) - at > SEGMENT and (m := _CUT.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class ByteSplit:
    """Pieces of the byte-level vocabularies: they join to the text."""

    near, far = _near(BYTE_PATTERN), regex.compile(BYTE_PATTERN)

    def __call__(self, text: str) -> list[str]:
        return (self.far if FAR.search(text) else self.near).findall(text)


class WordSplit:
    """Pieces of the word-end vocabulary: white space dropped, NFC, lower case.

    With whole_far, chunks between white space that hold far characters are left as they are.
    """

    near, far, space = _near(WORD_PATTERN), regex.compile(WORD_PATTERN), regex.compile(r"\s+")

    def __init__(self, whole_far: bool = False) -> None:
        self.whole_far = whole_far

    def __call__(self, text: str) -> list[str]:
        if not FAR.search(text):
            return self.near.findall(text.lower())
        out = []
        for chunk in self.space.split(text) if _ODD_SPACE.search(text) else text.split():
            if not FAR.search(chunk):
                out += self.near.findall(chunk.lower())
            elif self.whole_far:
                out.append(chunk)
            else:
                chunk = unicodedata.normalize("NFC", chunk)
                out += self.far.findall("".join(map(str.lower, chunk)))  # each character by itself
        return out


class PieceTable:
    """Numbers of keys (pieces, or whatever learn() knows) and a short array of integers for each.

    Looking up a batch of keys numbers the new ones in passing; they are then learned together, and all values are
    gathered by numpy. A table that holds too much starts anew before the next batch, so a worker's memory is bounded.
    """

    def __init__(self, learn: Callable[[list], Iterable[bytes]], dtype: str) -> None:
        self.learn, self.dtype = learn, np.dtype(dtype)
        self._start_anew()

    def _start_anew(self) -> None:
        self.number: dict = defaultdict(itertools.count().__next__)
        self.known, self.chars, self.flat, self.used = 0, 0, np.empty(1 << 16, self.dtype), 0
        self.start, self.size = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def _settle(self) -> None:
        """Learn the keys that were numbered since."""
        new = list(itertools.islice(reversed(self.number), len(self.number) - self.known))[::-1]
        if not new:
            return
        values = list(self.learn(new))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(values), self.dtype)
        total, used = self.known + len(new), self.used + len(flat)
        while len(self.start) < total:
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        while len(self.flat) < used:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : used] = flat
        self.size[self.known : total] = sizes
        self.start[self.known : total] = self.used + np.cumsum(sizes) - sizes
        self.known, self.used = total, used
        self.chars += sum(len(k) for k in new if isinstance(k, str))

    def gather(self, texts: list[Iterable[list]]) -> tuple[np.ndarray, np.ndarray]:
        """The values of each text's keys (lists of keys, one after the other), and where each text's values end."""
        if self.known > TABLE_PIECES or self.chars > TABLE_CHARS or self.used > TABLE_CHARS:
            self._start_anew()
        find, lists, counts = self.number.__getitem__, [np.zeros(0, np.int32)], []
        for text in texts:
            n = 0
            for keys in text:
                lists.append(np.fromiter(map(find, keys), np.int32, len(keys)))
                n += len(keys)
            counts.append(n)
        self._settle()
        numbers = np.concatenate(lists)
        after = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(self.size[numbers], out=after[1:])
        out = np.empty(after[-1], self.dtype)
        for k in range(0, len(numbers), 1 << 18):  # places are wider than values
            some = numbers[k : k + (1 << 18)]
            low, high = after[k], after[k + len(some)]
            places = np.repeat(self.start[some] - after[k : k + len(some)], self.size[some])
            out[low:high] = self.flat[places + np.arange(low, high)]
        return out, after[np.cumsum(counts, dtype=np.int64)]
