"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features for looser spellings.

The field is trained on the driver from a small labelled table (a fixed number of sentences made from the templates below;
another table can be passed), by gradient ascent on the regularised log-likelihood with a scaled forward-backward pass. It
is decoded by Viterbi in numpy batches. A sequence to decode is a trigger (a digit, an at sign, a bracketed or spelt-out
"at" or "dot") with ``REACH`` tokens on either side; overlapping ones are one sequence. Text without a trigger is
not decoded: an address spelt with a plain "at" and a dot ("bob at example.com"), with no trigger near it, is left out.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- fixed patterns ---------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterable[Span]:
    # around every at sign: what stands before it decides where the leftmost match begins, so no text is read twice
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterable[Span]:
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield "ip", at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by kind, then start: offsets in code points, ends exclusive."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _NUMBER.search(text):
        out += _ips(text)
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# --- the field --------------------------------------------------------------------------------------------------------

TAGS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
TAG = {t: i for i, t in enumerate(TAGS)}
REACH = 10
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|\w")
_TRIGGER = re.compile(r"[0-9@]+|[(\[{] ?at ?[)\]}]|\bdot\b", re.IGNORECASE)
#: Words whose identity matters; all others are seen by their shape.
CUES = frozenset("at dot com org net phone tel call mobile fax card visa ip host address server mail email contact".split())
OFFSETS = (-2, -1, 0, 1, 2)
#: Possible moves: I-kind follows only B-kind or I-kind.
_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])


def shape(token: str, glued: bool) -> str:
    low = token.lower()
    if token[0].isdigit():
        kind = f"9{len(token) if len(token) < 5 else 5 if len(token) < 13 else 13}"
    elif low in CUES:
        kind = low
    elif token[0].isalpha():
        kind = "Xx" if token[:1].isupper() and token[1:].islower() else "X" if token.isupper() else "x"
    else:
        kind = token if token in "@.()[]{}+-:/_," else "?"
    return kind + "'" * glued


def tokenize(text: str, start: int = 0, stop: int | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """Shapes and places of the tokens; a quote marks a token that touches the one before it."""
    shapes, places, end = [], [], -1
    for m in _TOKEN.finditer(text, start, len(text) if stop is None else stop):
        shapes.append(shape(m.group(), m.start() == end))
        places.append(m.span())
        end = m.end()
    return shapes, places


class Field:
    """Weights of the shapes at each offset, and of the moves between tags."""

    def __init__(self, shapes: dict[str, int]):
        self.shapes = shapes
        self.emit = np.zeros((len(OFFSETS), len(shapes) + 2, len(TAGS)))  # the last two: unknown, outside
        self.move = np.zeros((len(TAGS), len(TAGS)))

    def features(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Shape numbers (sequence, offset, place), filled up to the longest, and the mask of real places."""
        longest, unknown, outside = max(map(len, sequences)), len(self.shapes), len(self.shapes) + 1
        pad = max(OFFSETS)
        ids = np.full((len(sequences), longest + 2 * pad), outside)
        for row, sequence in zip(ids, sequences, strict=True):
            row[pad : pad + len(sequence)] = [self.shapes.get(s, unknown) for s in sequence]
        mask = np.arange(longest) < np.array([len(s) for s in sequences])[:, None]
        return np.stack([ids[:, pad + o : pad + o + longest] for o in OFFSETS], axis=1), mask

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][ids[:, k]] for k in range(len(OFFSETS)))

    def train(self, sequences: list[list[str]], tags: list[list[str]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
        ids, mask = self.features(sequences)
        n, longest = mask.shape
        gold = np.zeros((n, longest), dtype=int)
        for row, t in zip(gold, tags, strict=True):
            row[: len(t)] = [TAG[x] for x in t]
        one = np.eye(len(TAGS))[gold] * mask[..., None]
        seen_moves = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
        begin = np.array([not t.startswith("I") for t in TAGS]) * 1.0
        momentum = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        square = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, rounds + 1):
            e = self.scores(ids)
            e = np.exp(e - e.max(axis=2, keepdims=True))
            move = np.exp(self.move) * _ALLOWED
            ahead, back = np.zeros_like(e), np.ones_like(e)
            scale = np.ones((n, longest))
            now = e[:, 0] * begin
            for t in range(longest):
                if t:
                    now = np.where(mask[:, t, None], (now @ move) * e[:, t], now)
                scale[:, t] = now.sum(axis=1)
                now = now / scale[:, t, None]
                ahead[:, t] = now
            for t in range(longest - 2, -1, -1):
                back[:, t] = np.where(mask[:, t + 1, None], ((back[:, t + 1] * e[:, t + 1]) @ move.T) / scale[:, t + 1, None], back[:, t])
            state = ahead * back
            state /= np.maximum(state.sum(axis=2, keepdims=True), 1e-300)
            state *= mask[..., None]
            inner = (back[:, 1:] * e[:, 1:]) / scale[:, 1:, None] * mask[:, 1:, None]
            moves = move * np.einsum("nta,ntb->ab", ahead[:, :-1], inner)
            wrong = (one - state).reshape(-1, len(TAGS))
            gradient = [np.zeros_like(self.emit), (seen_moves - moves) / n - decay * self.move]
            for k in range(len(OFFSETS)):
                np.add.at(gradient[0][k], ids[:, k].ravel(), wrong)
            gradient[0] = gradient[0] / n - decay * self.emit
            for weights, g, m, v in zip((self.emit, self.move), gradient, momentum, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weights += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, sequences: list[list[str]], cells: int = 1 << 16) -> list[np.ndarray]:
        """Best tags of every sequence (Viterbi); sequences of like length go in batches of at most ``cells`` places."""
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: len(sequences[i]))
        move = np.where(_ALLOWED, self.move, -1e9)
        begin = np.where([t.startswith("I") for t in TAGS], -1e9, 0.0)
        while order:
            size = max(1, min(len(order), cells // len(sequences[order[-1]])))
            order, now = order[:-size], order[-size:]
            ids, mask = self.features([sequences[i] for i in now])
            e = self.scores(ids)
            best = e[:, 0] + begin
            back = np.zeros(e.shape, dtype=np.int8)
            for t in range(1, e.shape[1]):
                through = best[:, :, None] + move
                back[:, t] = np.where(mask[:, t, None], through.argmax(axis=1), np.arange(len(TAGS)))
                best = np.where(mask[:, t, None], through.max(axis=1) + e[:, t], best)
            tags = np.zeros(mask.shape, dtype=int)
            last = best.argmax(axis=1)
            for t in range(e.shape[1] - 1, -1, -1):
                tags[:, t] = last
                last = back[np.arange(len(now)), t, last] if t else last
            for i, row in zip(now, tags, strict=True):
                out[i] = row[: len(sequences[i])]
        return out


def labelled_table(sentences: int = 320, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The small labelled table: (sentence, its spans). Looser spellings of the four kinds, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdmh") for _ in range(r.randint(2, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    byte = lambda: str(r.randint(0, 255))

    def email() -> str:
        at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), (" AT ", " DOT "), ("@", " . "), ("@", ".")])
        name = r.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}", f"{word()}.{digits(2)}"])
        return name + at + dot.join([word(), *([word()] if r.random() < 0.4 else []), r.choice(["com", "org", "net", word()[:3]])])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b} {c}", f"+ {digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(1)} ({a}) {b}-{c}", f"1-{a}-{b}-{c}"])

    def ip() -> str:
        return r.choice([".", "[.]", " . ", "(.)", "."]).join(byte() for _ in range(4))

    def card() -> str:
        return r.choice([".", " - ", "/", " ", "-", "_", "", ""]).join(digits(4) for _ in range(4))

    def other() -> str:
        number = str(r.randint(0, 3000))
        return r.choice([number, f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 24)}:{digits(2)}", f"{number},{digits(3)}", f"password={hashlib.md5(digits(9).encode()).hexdigest()[:18]}", f"{digits(10)}", f"{digits(3)}", f"{word()}{digits(2)}", f"{number} {number}", "dot", "at", f"{digits(1)}.{digits(1)}.", f"({r.randint(1, 99)})", f"[{r.randint(1, 99)}]", f"{digits(2)}%", f"@{word()}", f"{digits(3)}-{digits(3)}"])

    made = []
    for _ in range(sentences):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice([word(), word(), word(), word().title(), r.choice(sorted(CUES))]) for _ in range(r.randint(1, 5))) + r.choice([" ", " ", " ", ": ", ", ", ". "])
            kind = r.choice(["email", "phone", "ip", "card", "", "", "", ""])
            value = {"email": email, "phone": phone, "ip": ip, "card": card, "": other}[kind]()
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice([" ", " ", ". ", ", "])
        made.append((text + " ".join(word() for _ in range(r.randint(0, 4))), spans))
    return made


def train(table: Iterable[tuple[str, list[Span]]] | None = None) -> Field:
    """Fits the field to a labelled table: rows (text, spans)."""
    sequences, tags = [], []
    for text, spans in labelled_table() if table is None else table:
        shapes, places = tokenize(text)
        row = ["O"] * len(shapes)
        for kind, start, end in spans:
            inside = [i for i, (a, b) in enumerate(places) if a >= start and b <= end]
            for i in inside:
                row[i] = f"{'B' if i == inside[0] else 'I'}-{kind}"
        if shapes:
            sequences.append(shapes)
            tags.append(row)
    names = {s: i for i, s in enumerate(sorted({s for q in sequences for s in q}))}
    return Field(names).train(sequences, tags)


@cache
def default_field() -> Field:
    """The field of the labelled table above, trained once in a driver."""
    return train()


def _plausible(kind: str, value: str) -> bool:
    """What a decoded span must hold to be reported."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", value, re.IGNORECASE) and re.search(r"\.|\bdot\b", value, re.IGNORECASE))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(map(_octet, parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not digits == value


def windows(text: str) -> Iterable[tuple[list[str], list[tuple[int, int]]]]:
    """The sequences to decode: tokens around the triggers of a text."""
    if not _TRIGGER.search(text):
        return
    end, runs = 0, []
    for m in _TRIGGER.finditer(text):
        # REACH tokens back: tokens are short, so the characters read are few; a token cut in two stays outside
        if runs and m.start() <= runs[-1][1]:
            start = runs.pop()[0]
        else:
            start, left = m.start(), 0
            while start > end and left <= REACH:
                start -= 1
                left += text[start].isspace()
        stop, left = m.end(), 0
        while stop < len(text) and left <= REACH:
            left += text[stop].isspace()
            stop += 1
        runs.append((start, stop))
        end = stop
    for start, stop in runs:
        shapes, places = tokenize(text, start, stop)
        if shapes:
            yield shapes, places


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the fixed patterns, all spans) of every text; a decoded span that meets a fixed one is dropped."""
    base = [base_spans(t) for t in texts]
    held = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    added: list[list[Span]] = [[] for _ in texts]
    for (i, (_, places)), tags in zip(held, field.decode([w[0] for _, w in held]) if held else [], strict=True):
        t = 0
        while t < len(tags):
            name = TAGS[tags[t]]
            stop = t + 1
            if name != "O":
                while stop < len(tags) and TAGS[tags[stop]] == f"I-{name[2:]}":
                    stop += 1
                a, b = places[t][0], places[stop - 1][1]
                if _plausible(name[2:], texts[i][a:b]):
                    added[i].append((name[2:], a, b))
            t = stop
    out = []
    for spans, more in zip(base, added, strict=True):
        taken = sorted((a, b) for _, a, b in spans)
        free = [s for s in more if not any(s[1] < b and a < s[2] for a, b in taken)]
        out.append((spans, sorted(spans + free, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in capitals; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _map(docs: DataFrame, field: Field | None, emit, made: list[tuple[str, str]], others: list[str]) -> DataFrame:
    """The columns ``others`` of ``docs`` and what ``emit(texts, found)`` makes of each batch of texts."""
    field = field or default_field()
    names = [*others, *(name for name, _ in made)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), *(f"{name} {kind}" for name, kind in made)])

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, [len(t or "") for t in texts], 4_000_000):
                columns = emit(texts[a:b], find([t or "" for t in texts[a:b]], field))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), *columns], names=names)

    return docs.select("text", *others).mapInArrow(run, schema)


def report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, the numbers of matches of the fixed patterns by kind, the SHA-256 of their list, the list of all spans
    and the number of spans that the field added. Null texts count as empty and have none; repeated rows are reported each;
    an empty table gives no rows.
    """

    def emit(_, found):
        counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
        hashes = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        return [*counts, pa.array(hashes), pa.array([joined(spans) for _, spans in found]), pa.array([len(spans) - len(base) for base, spans in found], pa.int64())]

    made = [*((f"n_{kind}", "long") for kind in KINDS), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]
    return _map(docs, field, emit, made, ["doc_id"])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with all spans of its texts masked; every other column stays, null texts stay null, as do empty tables."""

    def emit(texts, found):
        return [pa.array([None if t is None else mask(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())]

    return _map(docs, field, emit, [("text", "string")], [c for c in docs.columns if c != "text"]).select(*docs.columns)
