"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole candidate spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

KINDS = ("email", "ip", "card", "phone")
#: Atoms (runs of letters, runs of digits, single other characters) that one entity can have.
MOST_ATOMS = 24
#: Generated examples the field is fitted on, and passes over them.
EXAMPLES, PASSES = 260, 25
#: Islands whose segmentation a worker remembers.
REMEMBERED = 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Words with a digit or an at sign, next to each other: nothing else can hold an entity.
_ISLAND = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if place % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _octets(parts: Sequence[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, looked for around each at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind; ordered."""
    if not _TRIGGER.search(text):
        return []
    out = [(i, 0, j) for i, j in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# The field: segments of an island are one atom of nothing, or a whole entity of up to MOST_ATOMS atoms.

_ALLOWED = tuple(map(frozenset, (_LOCAL | {"@"}, "0123456789.", "0123456789 -", "0123456789 ().+-/")))


def _possible(kind: int, span: str, digits: str) -> bool:
    """Bounds on what can be an entity of a kind at all."""
    if kind == 0:
        return span.count("@") == 1 and span[0] not in ".@" and (span[-1].isalnum()) and "." in span.partition("@")[2]
    if not (span[-1].isdigit() and (span[0].isdigit() or kind == 3 and span[0] in "+(")):
        return False
    if kind == 1:
        return span.count(".") == 3 and ".." not in span
    return 12 <= len(digits) <= 19 if kind == 2 else 7 <= len(digits) <= 15


def _edge(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "alnum" if c.isalnum() else "quote" if c in "\"'()[]<>,;:!?" else c


def span_features(kind: int, span: str, before: str, after: str, after_next: str) -> list[str]:
    """Features of a whole span: its shape, checks on all of it, and what stands beside it."""
    digits = _NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span))))
    stop = "stop" if after == "." and not after_next.isalnum() else _edge(after)
    out = ["bias", f"before={_edge(before)}", f"after={stop}"]
    if kind == 0:
        domain = span.partition("@")[2]
        last = domain.rpartition(".")[2]
        out += [f"last={'alpha' if last.isalpha() and len(last) > 1 else 'other'}", f"dots={'..' in span or '.-' in span}"]
        out += [f"local={span.partition('@')[0][-1].isalnum()}"]
    elif kind == 1:
        out += [f"octets={_octets(span.split('.'))}", f"zero={any(p != '0' and p[0] == '0' for p in span.split('.'))}"]
    elif kind == 2:
        out += [f"luhn={luhn(digits)}", f"groups={'one' if len(groups) == 1 else '4' if set(groups[:-1]) == {4} else 'odd'}", f"n={len(digits)}"]
        out += [f"mixed={len(marks) > 1}"]
    else:
        shape = "-".join(map(str, groups[-3:]))
        out += [f"plus={span[0] == '+'}", f"shape={shape}", f"paren={'(' in span and ')' in span}", f"marks={marks}", f"n={len(digits)}"]
        out += [f"one={len(groups) == 1}", f"lone={span.count('(') != span.count(')')}"]
    return [f"{KINDS[kind]}:{f}" for f in out]


def _atoms(island: str) -> list[int]:
    """Offsets of the atoms and of the end."""
    return [m.start() for m in _ATOM.finditer(island)] + [len(island)]


def _entities_from(island: str, atoms: list[int], i: int) -> Iterator[tuple[int, int]]:
    """(atom behind, kind) of what can be an entity that begins with an atom."""
    alive = [k for k in range(4) if island[atoms[i]] in _ALLOWED[k]]
    for j in range(i + 1, min(len(atoms) - 1, i + MOST_ATOMS) + 1):
        part = island[atoms[j - 1] : atoms[j]]
        alive = [k for k in alive if _ALLOWED[k].issuperset(part)]
        if not alive:
            return
        span = island[atoms[i] : atoms[j]]
        digits = _NOT_DIGIT.sub("", span)
        if len(digits) > 19 and 0 not in alive:
            return
        yield from ((j, k) for k in alive if _possible(k, span, digits))


def candidates(island: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(offsets of the atoms and of the end, possible entities as (first atom, atom behind, kind))."""
    atoms = _atoms(island)
    return atoms, [(i, j, k) for i in range(len(atoms) - 1) for j, k in _entities_from(island, atoms, i)]


def _features_of(island: str, atoms: list[int], i: int, j: int, k: int) -> list[str]:
    at = lambda p: island[p : p + 1] if p >= 0 else ""
    return span_features(k, island[atoms[i] : atoms[j]], at(atoms[i] - 1), at(atoms[j]), at(atoms[j] + 1))


def _featured(island: str, atoms: list[int], found: list[tuple[int, int, int]]) -> list[list[str]]:
    return [_features_of(island, atoms, i, j, k) for i, j, k in found]


def _lattice(n: int, found: Sequence[tuple[int, int, int]], scores: Sequence[float]) -> list[list[tuple[int, int, float, int]]]:
    """Segments by their end: (start, label, score, number); label 4 is one atom of nothing with score 0."""
    ends: list[list[tuple[int, int, float, int]]] = [[] for _ in range(n + 1)]
    for number, ((i, j, k), s) in enumerate(zip(found, scores)):
        ends[j].append((i, k, s, number))
    for j in range(1, n + 1):
        ends[j].append((j - 1, 4, 0.0, -1))
    return ends


class Field:
    """Weights of span features and of pairs of neighbouring labels (4: nothing)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)

    def pair(self, a: int, b: int) -> str:
        return f"pair={a},{b}" if a < 4 and b < 4 else ""

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def best(self, island: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the entities of the best segmentation, in characters of the island.

        Entities are scored as the walk comes to where they begin, and none is kept: of every place only the best sum for
        each label and where it came from, some eighty bytes.
        """
        atoms = _atoms(island)
        n = len(atoms) - 1
        pairs = [[self.weights.get(self.pair(a, b), 0.0) for b in range(5)] for a in range(5)]
        top, start, label_before = array("d", [-math.inf]) * (5 * n + 5), array("i", [0]) * (5 * n + 5), array("b", [4]) * (5 * n + 5)
        top[4] = 0.0
        some = False
        for i in range(n):
            steps = [(j, k, self.score(_features_of(island, atoms, i, j, k))) for j, k in _entities_from(island, atoms, i)]
            some = some or bool(steps)
            for j, k, s in (*steps, (i + 1, 4, 0.0)):
                for before in range(5):
                    total = top[5 * i + before] + s + pairs[before][k]
                    if total > top[5 * j + k]:
                        top[5 * j + k], start[5 * j + k], label_before[5 * j + k] = total, i, before
        if not some:
            return []
        out, j, label = [], n, max(range(5), key=lambda x: (top[5 * n + x], x))
        while j:
            i, before = start[5 * j + label], label_before[5 * j + label]
            if label < 4:
                out.append((atoms[i], label, atoms[j]))
            j, label = i, before
        return out[::-1]

    def gradient(self, example: tuple) -> dict[str, float]:
        """Gradient of the log-likelihood of a labelled island: observed less expected features."""
        n, found, features, gold = example
        ends = _lattice(n, found, [self.score(f) for f in features])
        add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        weight = lambda a, b: self.weights.get(self.pair(a, b), 0.0)
        ahead = [[-math.inf] * 5 for _ in range(n + 1)]
        ahead[0][4] = 0.0
        for j in range(1, n + 1):
            for i, label, s, _ in ends[j]:
                for before in range(5):
                    if ahead[i][before] > -math.inf:
                        ahead[j][label] = add(ahead[j][label], ahead[i][before] + s + weight(before, label))
        total = -math.inf
        for x in ahead[n]:
            total = add(total, x)
        behind = [[-math.inf] * 5 for _ in range(n + 1)]
        behind[n] = [0.0] * 5
        out: dict[str, float] = defaultdict(float)
        for j in range(n, 0, -1):
            for i, label, s, number in ends[j]:
                if behind[j][label] == -math.inf:
                    continue
                for before in range(5):
                    if ahead[i][before] == -math.inf:
                        continue
                    step = s + weight(before, label) + behind[j][label]
                    behind[i][before] = add(behind[i][before], step)
                    chance = math.exp(ahead[i][before] + step - total)
                    if number >= 0:
                        for f in features[number]:
                            out[f] -= chance
                    if self.pair(before, label):
                        out[self.pair(before, label)] -= chance
        for number in gold:
            for f in features[number]:
                out[f] += 1
        return out


def _with_luhn(rnd: random.Random, n: int) -> str:
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def examples(number: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled islands: spans in usual and less usual spellings, and numbers that are no personal data."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 7)))
    octet = lambda: str(rnd.randint(0, 255))

    def card() -> str:
        digits, sep = _with_luhn(rnd, 16), rnd.choice(["", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = rnd.choice("23456789") + d(2), d(3), d(4)
        form = rnd.choice(["+1 ({}) {}-{}", "+1-{}-{}-{}", "({}) {}-{}", "({}){}-{}", "{}-{}-{}", "+44 {} {} {}", "+49 {} {}{}", "1-{}-{}-{}"])
        return form.format(a, b, c)

    good = {
        0: lambda: rnd.choice(["{}.{}@{}.{}.com", "{}{}@{}.org", "{}_{}@{}-{}.net", "{}+{}@{}.co.uk"]).format(w(), rnd.choice([w(), d(2)]), w(), w()),
        1: lambda: ".".join(octet() for _ in range(4)),
        2: card,
        3: phone,
    }
    bad = [
        lambda: f"{d(1)}.{d(1)}.",
        lambda: f"20{d(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}",
        lambda: f"{rnd.randint(1, 28)}.0{rnd.randint(1, 9)}.20{d(2)}",
        lambda: f"{rnd.randint(10, 23)}:{rnd.randint(10, 59)}",
        lambda: f"{d(1)},{d(3)}.{d(2)}",
        lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{w()}{d(3)}{w()}{d(2)}",
        lambda: f"{w()}@{w()}",
        lambda: f"@{w()}{d(2)}",
        lambda: f"{d(4)}-{d(4)}",
        lambda: f"{d(4)} {d(4)}",
        lambda: f"{d(7)}",
        lambda: d(rnd.choice([8, 9, 10, 11, 12, 13])),
        lambda: f"{rnd.randint(256, 999)}.{d(3)}.{rnd.randint(300, 999)}.{d(2)}",
        lambda: f"{d(1)}.{d(2)}.{d(1)}.{d(1)}.{d(2)}",
        lambda: next(x for x in iter(lambda: "4" + d(15), None) if not luhn(x)),
        lambda: f"{d(3)} {d(3)} {d(4)} {d(2)}",
        lambda: f"{d(2)} {d(2)} {d(3)}",
        lambda: f"{d(3)},{d(3)} {d(2)}.{d(1)}",
    ]
    out = []
    for k in range(number):
        text, spans = "", []
        for _ in range(rnd.choice([1, 1, 2])):
            text += " " if text else ""
            kind = k % 8
            piece = good[kind]() if kind < 4 else rnd.choice(bad)()
            left, right = rnd.choice([("", ""), ("", ""), ("", "."), ("", ","), ("(", ")"), ("<", ">")] if kind < 4 else [("", "")])
            if piece.startswith("("):
                left = right = ""
            if kind < 4:
                spans.append((len(text + left), kind, len(text + left + piece)))
            text += left + piece + right
            if kind == 3 or kind == 2:
                break  # two of them side by side can be read in several ways
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def train(number: int = EXAMPLES, passes: int = PASSES, seed: int = 7, decay: float = 0.02) -> Field:
    """Fit the field to generated examples: penalised likelihood, adaptive steps, fixed order. Takes a few seconds."""
    field, data = Field(), []
    for text, spans in examples(number, seed):
        atoms, found = candidates(text)
        place = {(atoms[i], k, atoms[j]): number for number, (i, j, k) in enumerate(found)}
        if all(s in place for s in spans):
            data.append((len(atoms) - 1, found, _featured(text, atoms, found), [place[s] for s in spans]))
    square: dict[str, float] = defaultdict(float)
    for _ in range(passes):
        for example in data:
            if not example[1]:
                continue
            for f, g in field.gradient(example).items():
                g -= decay * field.weights[f] / 10
                square[f] += g * g
                field.weights[f] += 0.5 * g / math.sqrt(square[f] + 1e-9)
    return field


class Finder:
    """Finds the spans of texts in one process."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.field = Field()
        self.field.weights.update(weights)
        self.known: dict[str, list[tuple[int, int, int]]] = {}

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the field that touch no span of the patterns."""
        out = []
        # The patterns' spans, run together where they overlap: at most one run can touch a span from the left.
        begins: list[int] = []
        ends: list[int] = []
        for i, _, j in base:
            if ends and i < ends[-1]:
                ends[-1] = max(ends[-1], j)
            else:
                begins.append(i)
                ends.append(j)
        for m in _ISLAND.finditer(text):
            found = self.known.get(m[0])
            if found is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.field.best(m[0])
                if len(m[0]) < 200:
                    self.known[m[0]] = found
            for i, kind, j in found:
                i, j = i + m.start(), j + m.start()
                before = bisect_left(begins, j) - 1
                if before < 0 or ends[before] <= i:
                    out.append((i, kind, j))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        return base, sorted(base + self.added(text, base)) if _TRIGGER.search(text) else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, end = [], 0
    for i, kind, j in spans:
        if i >= end:
            out += [text[end:i], f"[{KINDS[kind].upper()}]"]
        end = max(end, j)
    return "".join([*out, text[end:]])


def find_personal_data(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 and spans; with ``redacted`` also redacted_text.

    The patterns' spans stay as they are. Words with a digit or an at sign that stand next to each other are
    an island; the field cuts each island into entities of at most ``MOST_ATOMS`` atoms and single atoms of nothing, boundaries and kinds
    at once, and its entities are added where they touch no pattern's span. Offsets count code points. One pass, no
    shuffle. A NULL text is empty and has no spans (redacted: NULL); repeated rows are judged alike. New columns replace old ones of
    the same name.
    """
    weights = dict(train().weights)
    new = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"] + ["redacted_text"] * redacted
    place = docs.columns.index(text)
    rest = [c for c in docs.columns if c not in new]
    added = StructType.fromDDL(", ".join(f"{c} {'long' if c.startswith('n_') else 'string'}" for c in new))
    schema = StructType([*(f for f in docs.schema if f.name in rest), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(weights)
        for batch in batches:
            rows = []
            for value in batch.column(place):
                own = value.as_py()
                base, every = finder.spans(own or "")
                row = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)]
                if redacted:
                    row.append(own if own is None else redact(own, every))
                rows.append(row)
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in new]
            columns += [pa.array([r[k] for r in rows], pa.int64() if c.startswith("n_") else pa.string()) for k, c in enumerate(new)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *new])

    return docs.mapInArrow(run, schema)
