"""Personal data: base patterns plus a semi-Markov conditional random field over what they leave."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_schema, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Fixed base patterns. Looking behind only skips starts that cannot match, so runs of digits cost linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens of a segment at most, characters of one at most, and the posterior from which a segment is taken.
MAX_TOKENS, MAX_CHARS, SURE = 15, 64, 0.7


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: each @ takes the run before it (back to the last match) and the domain after it."""
    out, limit, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > limit and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            limit = found.end()
            out.append((start, limit))
        at = text.find("@", max(at + 1, limit))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches that pass their checks, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# The field. Segments of kind -1 are single tokens outside any entity; others are spans of at most MAX_TOKENS tokens.

_TOKEN = re.compile(r"[^\s()\[\]<>{},;:\"'!?|*#&$%=~^`\\/]+(?<![.\-])|[^\s]")
_VEILED = re.compile(r"[\w.+-]+ ?[(\[{<]? ?at ?[)\]}>]? ?[\w-]+(?: ?[(\[{<]? ?dot ?[)\]}>]? ?[A-Za-z]{2,})+", re.I)
_SPACED = re.compile(r"[\w.+-]+ ?@ ?[\w-]+(?: ?\. ?[A-Za-z]{2,})+")
_DIGIT = re.compile("[0-9]")
_DIAL = re.compile(r"\+?\(?[0-9]{1,4}\)?(?:[ .\-]?\(?[0-9]{2,4}\)?){2,4}")
#: Where tokens end for certain: white space, and marks that are tokens of their own.
_EDGE = re.compile(r"[\s()\[\]<>{},;:\"'!?|*#&$%=~^`\\/]")
_SIGN = re.compile("@|dot", re.I)
_HEX6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}")
_CUES = {
    "email": 0, "mail": 0, "contact": 0, "write": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2, "credit": 2,
    "mastercard": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "cell": 3, "telephone": 3,
}


def _shape(text: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text)))


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def segment_features(text: str, spans: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole span of tokens i..j (inclusive); none if it cannot be an entity."""
    start, end = spans[i][0], spans[j][1]
    if end - start > MAX_CHARS:
        return []
    part = text[start:end]
    n_digits = len(_DIGIT.findall(part))
    veiled = (" " in part or "(" in part or "[" in part) and bool(_VEILED.fullmatch(part))
    at_sign = "@" in part
    if not (n_digits >= 7 or veiled or at_sign or part.count(":") >= 3 or (part.count(".") >= 3 and n_digits >= 4)):
        return []
    if not (part[0].isalnum() or part[0] in "+(") or not part[-1].isalnum():
        return []
    out = [f"shape={_shape(part)}", f"digits={n_digits}", f"tokens={j - i + 1}"]
    digits = "".join(_DIGIT.findall(part))
    kinds = "".join(sorted({c for c in part if not c.isalnum()}))
    letters = any(c.isalpha() for c in part)
    out.append(f"marks={kinds}|{letters}")
    if not letters and n_digits >= 13:
        out.append(f"luhn={luhn(digits)}|{n_digits in range(13, 20)}")
        groups = re.findall("[0-9]+", part)
        out.append(f"fours={luhn(digits) and all(len(g) == 4 for g in groups[:-1])}")
    if veiled:
        out.append("veiled")
    if at_sign:
        out.append(f"spaced={bool(_SPACED.fullmatch(part))}")
    parts = re.split(r"\.|\[\.\]| dot ", part)
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts):
        out.append(f"quad={all(int(p) <= 255 for p in parts)}")
    if _HEX6.fullmatch(part):
        out.append(f"colons={part.count(':')}")
    if not letters and 7 <= n_digits <= 15 and _DIAL.fullmatch(part):
        groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", part))
        out.append(f"dial={groups}|{'(' in part}|{'+' in part}")
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    out.append(f"edges={before.isalnum() or before in ('.', '-', '=', '_', '/', '$')}|{after.isalnum() or after in ("-", "_", "/")}")
    k, cue = i - 1, -1
    for _ in range(3):
        if k < 0:
            break
        cue = _CUES.get(text[spans[k][0] : spans[k][1]].lower(), -1)
        if cue >= 0:
            break
        k -= 1
    out.append(f"cue={cue}")
    return out


class SemiMarkov:
    """Weights of (feature, kind) and of neighbouring kinds; sums and posteriors over all segmentations."""

    def __init__(self, weights: dict | None = None) -> None:
        self.w = defaultdict(float, weights or {})

    def lattice(self, text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """For each end token, the (start, features) of the segments that may be entities."""
        return [[(i, f) for i in range(max(0, j - MAX_TOKENS + 1), j + 1) if (f := segment_features(text, spans, i, j))] for j in range(len(spans))]

    def scores(self, lattice) -> list[list[tuple[int, int, float]]]:
        w = self.w
        return [[(i, y, w["bias", y] + sum(w[f, y] for f in feats)) for i, feats in row for y in range(len(KINDS))] for row in lattice]

    def _forward(self, scored) -> list[dict[int, float]]:
        """Log sums of all segmentations of tokens before j whose last segment is of a kind (-1: outside)."""
        table: list[dict[int, float]] = [{-1: 0.0}]
        for j, row in enumerate(scored):
            here = {-1: _log_sum([v + self.w["next", y, -1] for y, v in table[j].items()])}
            for y in {y for _, y, _ in row}:
                terms = [s + v + self.w["next", p, y] for i, k, s in row if k == y for p, v in table[i].items()]
                here[y] = _log_sum(terms)
            table.append(here)
        return table

    def posteriors(self, scored) -> dict[tuple[int, int, int], float]:
        """(start, end, kind) -> probability of that segment."""
        forward, n = self._forward(scored), len(scored)
        back: list[dict[int, float]] = [defaultdict(lambda: -math.inf) for _ in range(n + 1)]
        kinds = [-1, *range(len(KINDS))]
        back[n] = dict.fromkeys(kinds, 0.0)
        starts: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for j, row in enumerate(scored):
            for i, y, s in row:
                starts[i].append((j, y, s))
        for i in range(n - 1, -1, -1):
            back[i] = {p: _log_sum([self.w["next", p, -1] + back[i + 1][-1], *(self.w["next", p, y] + s + back[j + 1][y] for j, y, s in starts[i])]) for p in kinds}
        total = _log_sum(list(forward[n].values()))
        return {
            (i, j, y): math.exp(_log_sum([v + self.w["next", p, y] for p, v in forward[i].items()]) + s + back[j + 1][y] - total)
            for j, row in enumerate(scored)
            for i, y, s in row
        }

    def best(self, scored) -> list[tuple[int, int, int]]:
        """The segments of the highest scoring segmentation, by dynamic programming over bounded segments."""
        table: list[dict[int, tuple[float, tuple | None]]] = [{-1: (0.0, None)}]
        for j, row in enumerate(scored):
            here: dict[int, tuple[float, tuple | None]] = {}
            for i, y, s in [(j, -1, 0.0), *row]:
                for p, (v, _) in table[i].items():
                    value = v + s + self.w["next", p, y]
                    if y not in here or value > here[y][0]:
                        here[y] = (value, (i, p))
            table.append(here)
        y = max(table[-1], key=lambda k: table[-1][k][0])
        out, at = [], len(scored)
        while at:
            i, p = table[at][y][1]
            if y >= 0:
                out.append((i, at - 1, y))
            at, y = i, p
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Stochastic ascent of the conditional log-likelihood, with a step size of its own for each weight."""
        ready = []
        for text, gold in examples:
            spans = tokens(text, 0, len(text))
            first, last = {a: k for k, (a, _) in enumerate(spans)}, {b: k for k, (_, b) in enumerate(spans)}
            lattice = self.lattice(text, spans)
            want = {(first[a], last[b], y) for a, y, b in gold if a in first and b in last}
            ready.append((lattice, want))
        squares: dict = defaultdict(float)
        rng = random.Random(5)
        for _ in range(epochs):
            rng.shuffle(ready)
            for lattice, want in ready:
                gradient: dict = defaultdict(float)
                got = self.posteriors(self.scores(lattice))
                for j, row in enumerate(lattice):
                    for i, feats in row:
                        for y in range(len(KINDS)):
                            d = ((i, j, y) in want) - got[i, j, y]
                            if abs(d) > 1e-4:
                                gradient["bias", y] += d
                                for f in feats:
                                    gradient[f, y] += d
                for k, g in gradient.items():
                    g -= l2 * self.w[k]
                    squares[k] += g * g
                    self.w[k] += rate * g / (1e-3 + math.sqrt(squares[k]))


def _log_sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up sentences with entities in forms that the base patterns miss, and numbers that are no entities.

    Plain phone and card numbers stand side by side: there a base match runs on into the next number and fails.
    """
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "re", "bo", "st", "is", "en", "ka", "lu"]) for _ in range(rng.randint(1, 4)))

    def card(groups: list[int], mark: str) -> str:
        body = digits(sum(groups) - 1)
        body += next(d for d in "0123456789" if luhn(body + d))
        parts, at = [], 0
        for g in groups:
            parts.append(body[at : at + g])
            at += g
        return mark.join(parts)

    def bad_number(k: int) -> str:
        while True:
            if not luhn(out := digits(k)):
                return out

    def made() -> tuple[str, int, int | None]:
        """Text, kind (-1: none), a cue's kind."""
        pick = rng.randrange(20)
        host = f"{word()}{rng.choice(['', digits(1)])}"
        tld = rng.choice(["com", "org", "net", "de", "io"])
        quad = [str(rng.randrange(256)) for _ in range(4)]
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" AT ", " DOT ")])
        if pick == 0:
            return f"{word()}{at}{host}{dot}{tld}", 0, 0
        if pick == 1:
            return f"{word()}.{word()}{at}{host}{dot}{tld}", 0, 0
        if pick == 2:
            return f"{word()}{rng.choice([' @ ', '@ ', ' @'])}{host}.{tld}", 0, 0
        if pick == 3:
            return "[.]".join(quad), 1, 1
        if pick == 4:
            return " dot ".join(quad), 1, 1
        if pick == 5:
            return ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), 1, 1
        if pick == 6:
            return card([4, 4, 4, 4], "."), 2, 2
        if pick == 7:
            return card([4, 6, 5], "."), 2, 2
        if pick in (8, 9):
            return f"({digits(3)}) {digits(3)}-{digits(4)}", 3, 3
        if pick == 10:
            return f"{digits(3)}-{digits(3)}-{digits(4)}", 3, 3
        if pick == 11:
            return f"{digits(3)}.{digits(3)}.{digits(4)}", 3, 3
        if pick == 12:
            return rng.choice([bad_number(16), bad_number(15), digits(10), digits(8), digits(12), bad_number(16)]), -1, None
        if pick == 13:
            return rng.choice([f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}.{digits(4)}", f"Version {digits(1)}.0"]), -1, None
        if pick == 14:
            return rng.choice([f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"20{digits(2)}-20{digits(2)}"]), -1, None
        if pick == 15:
            return f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', -1, None
        if pick == 16:
            return rng.choice([f"{word()} at {word()} {word()}", f"{word()} dot {word()}", f"@{word()}", f"{word()}@{word()}"]), -1, None
        if pick == 17:
            return ".".join(str(rng.randrange(256, 1000)) for _ in range(4)), -1, None
        if pick == 18:
            return rng.choice([f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"${digits(3)},{digits(3)}.{digits(2)}", f"{digits(4)} {digits(4)}", f"{bad_number(4)} {digits(4)} {digits(4)}"]), -1, None
        return " ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(2, 8))), -1, None

    cues = {0: ["email", "mail", "contact"], 1: ["ip", "host", "server"], 2: ["card", "visa"], 3: ["phone", "tel", "call"]}
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 2)):
            entity, kind, cue = made()
            if rng.random() < 0.2:  # numbers side by side, which the base patterns run together
                text = f"{text} ".lstrip()
                for number, y in ((f"+{rng.randrange(1, 100)} ({digits(3)}) {digits(3)}-{digits(4)}", 3), rng.choice([(card([16], ""), 2), (card([4, 4, 4, 4], rng.choice(" -")), 2), (bad_number(16), -1), (bad_number(15), -1)])):
                    if y >= 0:
                        gold.append((len(text), y, len(text) + len(number)))
                    text += f"{number} "
                text = text.rstrip() + rng.choice(["", ".", ",", " |"])
            if cue is not None and rng.random() < 0.3:
                text += f" {rng.choice(cues[cue])}{rng.choice([':', ''])}"
            text = f"{text} ".lstrip()
            if kind >= 0:
                gold.append((len(text), kind, len(text) + len(entity)))
            text += entity + rng.choice(["", ".", ",", "!!", "%%%", " |"])
            text += " " + " ".join(word() for _ in range(rng.randint(1, 4)))
        out.append((text, gold))
    return out


def train(n: int = 700, seed: int = 1) -> SemiMarkov:
    """A field fitted to made-up sentences only: the same for every corpus."""
    field = SemiMarkov()
    field.fit(examples(n, seed))
    return field


@lru_cache(maxsize=1)
def trained() -> dict:
    return {k: v for k, v in train().w.items() if abs(v) > 1e-6}


def zones(text: str) -> list[list[int]]:
    """Stretches outside which no segment can be an entity.

    By segment_features an entity holds an at sign, the letters dot, seven digits, three colons, or four digits and three
    points, within MAX_CHARS characters. So it lies within MAX_CHARS of the ends of such a group.
    """
    groups = [(m.start(), m.end()) for m in _SIGN.finditer(text)]
    if text.count(":") >= 3:
        colons = [m.start() for m in re.finditer(":", text)]
        groups += [(a, b + 1) for a, b in zip(colons, colons[2:]) if b - a < MAX_CHARS]
    digits = [m.start() for m in _DIGIT.finditer(text)]
    groups += [(a, b + 1) for a, b in zip(digits, digits[6:]) if b - a < MAX_CHARS]
    if digits and text.count(".") >= 3:
        groups += [(a, b + 1) for a, b in zip(digits, digits[3:]) if b - a < MAX_CHARS and text.count(".", max(0, b + 1 - MAX_CHARS), a + MAX_CHARS) >= 3]
    out: list[list[int]] = []
    for low, high in sorted((max(0, b - MAX_CHARS), min(len(text), a + MAX_CHARS)) for a, b in groups):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _wider(text: str, low: int, high: int, first: int, last: int) -> tuple[int, int]:
    """The stretch with the three words before it, which cues may stand in, and the word after it, all within first to last."""
    for _ in range(4):
        while low > first and text[low - 1].isspace():
            low -= 1
        while low > first and not text[low - 1].isspace():
            low -= 1
    edge = _EDGE.search(text, high, last)
    high = edge.start() if edge else last
    while high < last and text[high].isspace():
        high += 1
    edge = _EDGE.search(text, high + 1, last) if high < last else None
    return low, edge.start() if edge else last


def _islands(lattice: list[list]) -> Iterator[tuple[int, int]]:
    """Runs of tokens that some segment covers, each with the token after it, which is outside any entity.

    What lies outside for certain parts the sequence: sums and best segmentations of the runs are those of the whole.
    """
    covered = [0] * (len(lattice) + 1)
    for j, row in enumerate(lattice):
        if row:
            covered[min(i for i, _ in row)] += 1
            covered[j + 1] -= 1
    covered = list(accumulate(covered))
    start = None
    for j, n in enumerate(covered):
        if n and start is None:
            start = j
        elif not n and start is not None:
            yield start, min(j + 1, len(lattice))
            start = None


def added_spans(field: SemiMarkov, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Segments that the field is sure of, in the whole text: what base spans leave are sequences of their own.

    Tokens that can be in no entity are passed over, which changes nothing (zones, _islands).
    """
    near, out, at, k = zones(text), [], 0, 0
    for a, b in [*((a, b) for a, _, b in sorted(base)), (len(text), len(text))]:
        first, last, at = at, a, max(at, b)
        while k < len(near) and near[k][1] <= first:
            k += 1
        parts: list[list[int]] = []
        j = k
        while j < len(near) and near[j][0] < last:
            low, high = _wider(text, max(near[j][0], first), min(near[j][1], last), first, last)
            j += 1
            if parts and low <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], high)
            else:
                parts.append([low, high])
        for low, high in parts:
            spans = tokens(text, low, high)
            lattice = field.lattice(text, spans)
            for start, end in _islands(lattice):
                scored = field.scores([[(i - start, f) for i, f in row] for row in lattice[start:end]])
                best = field.best(scored)
                sure = field.posteriors(scored) if best else {}
                out += [(spans[start + i][0], y, spans[start + j][1]) for i, j, y in best if sure[i, j, y] >= SURE]
    return out


def find_spans(field: SemiMarkov, text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) of all spans of a text, in order."""
    base = base_spans(text)
    return sorted([(a, y, b, True) for a, y, b in base] + [(a, y, b, False) for a, y, b in added_spans(field, text, base)])


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, y, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[y].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, spans (array of kind, start, end, base; code points, end exclusive; by start, then kind).

    Base spans are the fixed patterns' matches; the others come from the field, which reads the whole of what base spans
    leave, and touch no base span. No shuffle. Null and empty texts have no spans; long texts are read whole; spans of
    one start are in the order of KINDS; null ids and repeated rows pass through; an empty table gives no rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    id_type = docs.select(id_column).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = SemiMarkov(shared.value)
        found = [[{"kind": KINDS[y], "start": a, "end": b, "base": own} for a, y, b, own in find_spans(field, t.as_py() or "")] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_ARROW)], [id_column, "spans"])

    return map_arrow(docs.select(id_column, text_column), run, f"`{id_column}` {id_type}, spans {_SPAN}")


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """The columns of docs, spans in `text` replaced by their kind in brackets; a column n_chars is counted anew.

    Null texts stay null; repeated rows and null ids pass through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field, at = SemiMarkov(shared.value), batch.schema.get_field_index("text")
        texts = [None if (t := x.as_py()) is None else redact(t, find_spans(field, t)) for x in batch.column(at)]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = map_arrow(docs, run, columns_schema(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
