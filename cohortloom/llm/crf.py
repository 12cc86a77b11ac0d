"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

Base spans come from four patterns (email, ip, card, phone). The field labels words (B-/I- per kind, O) from
hashed word-shape features of a word and its neighbours. It is trained on the driver by gradient ascent on
the conditional log-likelihood of a small labelled table (at most MAX_LABELLED rows, a bound of the training
only), with all sequences in one padded numpy batch. Decoding is Viterbi in numpy batches inside the tasks.
Labels other than O are allowed only within CONTEXT words of a word with a digit, an `@` or a written-out
(at)/(dot); outside, the path is fixed to O, so cutting there changes nothing and whole texts are decoded.

A decoded span is added when it does not overlap a base span and its characters are plausible for its kind
(digit counts, checksum, number ranges). Base spans always stay.

Defined cases: NULL and empty texts have no spans. Texts of any length are searched whole; batches of
windows bound the memory. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 1 << 14
CONTEXT = 3
MAX_LABELLED = 4000
WINDOWS = 4096

# The base patterns. The look-behinds only skip starts inside a run that was tried from its start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit is the checksum of the others."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Each `@` takes the run of local characters before it, down to the end of the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            yield "email", start, m.end()
            done = after = m.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then by start."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _digits(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def words_near_triggers(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) within CONTEXT words of a trigger, in order."""
    places = [m.start() for m in _TRIGGER.finditer(text)]
    if not places:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    out, last = [], -1
    for place in places:
        at = bisect.bisect_right(starts, place) - 1
        low, high = max(at - CONTEXT, last + 1, 0), min(at + CONTEXT, len(words) - 1)
        if high <= last:
            continue
        if out and low == last + 1:
            out[-1] += words[low : high + 1]
        else:
            out.append(words[low : high + 1])
        last = high
    return out


def _shape(word: str) -> str:
    """Letter, digit and other runs: digits with their number, letters as x."""
    return re.sub(r"[^\W\d_]+", "x", re.sub(r"[0-9]+", lambda m: f"<{min(20, len(m[0]))}>", word))[:24]


def _outline(word: str) -> str:
    """The shape without run lengths."""
    return re.sub(r"<[0-9]+>", "9", _shape(word))


def features(words: list[str]) -> np.ndarray:
    """Hashed feature numbers, a row per word."""
    shapes = [_shape(w) for w in words]
    low = [w.lower().strip("\"'.,;:!?()[]{}*#$%&|=")[:12] if w.strip(".,:;").isalpha() else "" for w in words]
    edge = "^"
    rows = []
    for i, w in enumerate(words):
        digits = _digits(w)
        p1, p2 = (low[i - 1] if i else edge), (low[i - 2] if i > 1 else edge)
        n1 = low[i + 1] if i + 1 < len(words) else edge
        s1, s2 = (shapes[i - 1] if i else edge), (shapes[i + 1] if i + 1 < len(words) else edge)
        rows.append(
            (
                "bias", f"s={shapes[i]}", f"w={low[i]}", f"d={min(20, len(digits))}",
                f"c={len(digits) >= 13 and luhn(digits)}", f"@={'@' in w}{'.' in w[1:-1]}", f"f={_shape(w[:1])}", f"l={_shape(w[-2:])}",
                f"p={p1}", f"q={p2}", f"n={n1}", f"sp={s1}", f"sn={s2}", f"ss={s1}|{shapes[i]}", f"ps={p1}|{shapes[i]}",
                f"g={_outline(w)}", f"sg={s2}|{_outline(w)}", f"pg={s1}|{_outline(w)}",
            )
        )
    return np.array([[zlib.crc32(f.encode()) % FEATURES for f in row] for row in rows], dtype=np.int32)


@dataclass
class Field:
    """Weights: feature by label, label by label, first and last label."""

    state: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """0 where a move or a first label is possible, else a large negative number."""
    n = len(LABELS)
    moves, first = np.zeros((n, n)), np.zeros(n)
    for j, to in enumerate(LABELS):
        if to.startswith("I-"):
            first[j] = -1e4
            for i, source in enumerate(LABELS):
                if source[2:] != to[2:] or source == "O":
                    moves[i, j] = -1e4
    return moves, first


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), rows[0].shape[1]), dtype=np.int32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def train(sequences: list[tuple[list[str], list[str]]], rounds: int = 100, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adam on the whole batch."""
    x, lengths = _padded([features(words) for words, _ in sequences])
    count, width, _ = x.shape
    n = len(LABELS)
    y = np.zeros((count, width), dtype=np.int64)
    for k, (_, labels) in enumerate(sequences):
        y[k, : len(labels)] = [LABELS.index(v) for v in labels]
    inside = np.arange(width)[None, :] < lengths[:, None]
    bad_moves, bad_first = _allowed()
    sizes = [(FEATURES, n), (n, n), (n,), (n,)]
    cuts = np.cumsum([int(np.prod(s)) for s in sizes])[:-1]
    theta = np.zeros(sum(int(np.prod(s)) for s in sizes))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    every = np.arange(count)
    gold = np.zeros((count, width, n))
    gold[every[:, None], np.arange(width)[None, :], y] = inside
    used = x[inside].ravel()
    for step in range(1, rounds + 1):
        state, moves, first, last = [part.reshape(s) for part, s in zip(np.split(theta, cuts), sizes)]
        score = state[x].sum(axis=2)
        trans, begin = moves + bad_moves, first + bad_first
        alpha, beta = np.zeros((count, width, n)), np.zeros((count, width, n))
        alpha[:, 0] = begin + score[:, 0]
        for t in range(1, width):
            nxt = _lse(alpha[:, t - 1, :, None] + trans[None], 1) + score[:, t]
            alpha[:, t] = np.where(inside[:, t, None], nxt, alpha[:, t - 1])
        beta[:, width - 1] = last
        for t in range(width - 2, -1, -1):
            nxt = _lse(trans[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], nxt, last)
        total = _lse(alpha[:, -1] + last, 1)
        node = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
        diff = gold - node
        g_state = np.stack([np.bincount(used, np.repeat(diff[inside][:, j], x.shape[2]), FEATURES) for j in range(n)], axis=1)
        g_moves = np.zeros((n, n))
        for t in range(1, width):
            live = inside[:, t]
            pair = alpha[live, t - 1, :, None] + trans[None] + (score[live, t] + beta[live, t])[:, None, :] - total[live, None, None]
            g_moves -= np.exp(pair).sum(axis=0)
            np.add.at(g_moves, (y[live, t - 1], y[live, t]), 1)
        g_first = diff[:, 0].sum(axis=0)
        g_last = diff[every, lengths - 1].sum(axis=0)
        grad = np.concatenate([g_state.ravel(), g_moves.ravel(), g_first, g_last]) - penalty * theta
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    state, moves, first, last = [part.reshape(s) for part, s in zip(np.split(theta, cuts), sizes)]
    return Field(state.astype(np.float32), (moves + bad_moves).astype(np.float32), (first + bad_first).astype(np.float32), last.astype(np.float32))


def viterbi(field: Field, rows: list[np.ndarray]) -> list[list[str]]:
    """Best labels of each sequence of feature rows; sequences of similar length share a padded batch."""
    out: list[list[str]] = [[] for _ in rows]
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    at = 0
    while at < len(order):
        longest = max(16, 2 * len(rows[order[at]]))
        most = max(1, WINDOWS * 16 // longest)
        some = [k for k in order[at : at + most] if len(rows[k]) <= longest]
        at += len(some)
        x, lengths = _padded([rows[k] for k in some])
        score = field.state[x].sum(axis=2)
        best = field.first + score[:, 0]
        back = np.zeros(score.shape, dtype=np.int8)
        for t in range(1, x.shape[1]):
            reach = best[:, :, None] + field.moves[None]
            back[:, t] = reach.argmax(axis=1)
            live = (t < lengths)[:, None]
            best = np.where(live, reach.max(axis=1) + score[:, t], best)
        label = (best + field.last).argmax(axis=1)
        paths = np.zeros(score.shape[:2], dtype=np.int8)
        for t in range(x.shape[1] - 1, -1, -1):
            paths[:, t] = label
            label = np.where(t < lengths, back[np.arange(len(some)), t, label], label) if t else label
        for k, path, n in zip(some, paths, lengths):
            out[k] = [LABELS[v] for v in path[:n]]
    return out


def plausible(kind: str, found: str) -> bool:
    """Whether the characters can be of the kind."""
    digits = _digits(found)
    if kind == "email":
        return bool(re.fullmatch(r"\S+@\S+|\S+ ?[\[({]at[\])}] ?\S+( ?[\[({]dot[\])}] ?\S+)*", found, re.I))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", found.strip("[](){}"))
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .\-]", found)
    return 7 <= len(digits) <= 15 and not re.search(r"[^0-9+() ./\-]", found)


def _added(text: str, words: list[tuple[int, int]], labels: list[str], taken: list[Span]) -> Iterator[Span]:
    """Spans of a labelled window that overlap no base span."""
    k = 0
    while k < len(words):
        if not labels[k].startswith("B-"):
            k += 1
            continue
        kind, first = labels[k][2:], k
        k += 1
        while k < len(words) and labels[k] == f"I-{kind}":
            k += 1
        start, end = words[first][0], words[k - 1][1]
        lead = "\"'<[{,;:*#$%&|=" + ("" if kind == "phone" else "(")
        while start < end and text[start] in lead:
            start += 1
        while end > start and text[end - 1] in "\"'>]},;:.!?*#$%&|=" + ("" if text[start] == "(" and text[start:end].count("(") == text[start:end].count(")") else ")"):
            end -= 1
        if start < end and plausible(kind, text[start:end]) and all(end <= a or b <= start for _, a, b in taken):
            yield kind, start, end


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed and then by start."""
    base = [base_spans(t) if t else [] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []

    def decode() -> None:
        for (k, words, _), labels in zip(held, viterbi(field, [x for _, _, x in held])):
            added[k] += _added(texts[k], words, labels, base[k])
        held.clear()

    for k, t in enumerate(texts):
        for words in words_near_triggers(t) if t else []:
            held.append((k, words, features([t[a:b] for a, b in words])))
            if len(held) >= WINDOWS:
                decode()
    decode()
    order = {kind: i for i, kind in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (order[s[0]], s[1]))) for b, a in zip(base, added)]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Fixed values of the labelled table: cue words and sentence frames.
_FRAMES = (
    "{w} {w} contact {email} for {w}", "{w} mail to {email} {w}", "{w} {email} {w} {w}", "e-mail: {email}, {w}", "écrivez à {email} {w}",
    "{w} call {phone} {w}", "tel. {phone} {w} {w}", "{w} phone: {phone}", "{w} {w} {phone} {w}", "appelez le {phone} {w}", "Telefon {phone} {w}",
    "llame al {phone} {w}", "mobile {phone}, {w}", "{w} server {ip} {w}", "{w} from {ip} {w} {w}", "ip {ip} {w}", "{w} {w} {ip}", "host {ip} port {n}",
    "{w} card {card} {w}", "{w} {card} {w} {w}", "visa {card} {w}", "card number: {card}", "carte {card} {w}", "Karte {card} {w}",
    "{w} version {v} {w}", "Licensed under the {w} License, Version {v}.", "{w} CC BY-NC {v}.", "{w} {n} {w} {w}", "in {y} {w} {w}", "{w} {y}-{y} {w}",
    "{w} page {n} of {n}", "{w} {d} {w}", "{w} at {t} {w}", "{w} token = \"{hex}\" {w}", "{w} {big} {w}", "order {big} {w}", "isbn {isbn} {w}",
    "{w} {n}, {n} {w} {n} {w}", "price {n}.{n} {w}", "{w} section {v} {w}", "{w} {n}%% {w}", "{w} ({n}) {w}", "{w} {w} {w}", "table {n}: {n} {n} {n}",
)
_SYLLABLES = "an ber che der en for ge hat ing ion ka la men nt ou pa que re st th un ver wh za é ó ü ñ".split()


def _value(kind: str, r: random.Random) -> str:
    """A made-up value of a kind, in one of its spellings."""
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    plain = lambda: re.sub("[^a-z]", "a", word())
    if kind == "w":
        return word() + r.choice(["", "", "", ".", ",", " |", "!!", "***"])
    if kind == "email":
        host = f"{plain()}{r.choice(['', number(1)])}{r.choice(['.example', ''])}"
        local = r.choice([plain(), f"{plain()}.{number(2)}", f"{plain()}_{plain()}"])
        at, dot = r.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), ("@", ".")])
        return f"{local}{at}{host.replace('.', dot)}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".", ".", ".", "[.]", " . "]).join(parts)
    if kind == "card":
        body = r.choice("345") + number(14)
        card = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(card[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return r.choice(
            [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{number(2)} {a} {b} {c}", f"0{number(2)} {b} {c}", f"00{number(2)} {a} {b} {c}",
             f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"]
        )
    if kind == "big":
        while luhn(big := number(r.choice([9, 12, 14, 16, 18]))):
            pass
        return big
    return {
        "n": lambda: number(r.randint(1, 5)).lstrip("0") or "7", "y": lambda: str(r.randint(1900, 2030)), "v": lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}{r.choice(['', '.1', ''])}",
        "d": lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}"]),
        "t": lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), "isbn": lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
    }[kind]()


def labelled_rows(count: int = 1200, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Rows of the labelled table: frames filled in turn with values from a seeded generator."""
    r = random.Random(seed)
    rows = []
    for k in range(count):
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", _FRAMES[k % len(_FRAMES)].replace("%%", "%")):
            if part.startswith("{"):
                value = _value(part[1:-1], r)
                if part[1:-1] in KINDS:
                    spans.append((part[1:-1], len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession, count: int = 1200, seed: int = 11) -> DataFrame:
    """(text, spans) to train on."""
    rows = [(t, [{"kind": k, "start": a, "end": b} for k, a, b in s]) for t, s in labelled_rows(count, seed)]
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")


def sequence_of(text: str, spans: Iterable[Span]) -> tuple[list[str], list[str]]:
    """Words and labels of a labelled text."""
    words, labels, seen = [], [], set()
    for m in _WORD.finditer(text):
        hit = next((s for s in spans if s[1] < m.end() and m.start() < s[2]), None)
        words.append(m[0])
        labels.append("O" if hit is None else f"{'I' if hit in seen else 'B'}-{hit[0]}")
        seen.add(hit)
    return words, labels


def fit(labelled: DataFrame, most: int = MAX_LABELLED) -> Field:
    """Train on the labelled rows; more than `most` are refused, since they are held on the driver."""
    rows = labelled.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled rows")
    found = [sequence_of(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows if r["text"]]
    return train([(w, y) for w, y in found if w])


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; counts are of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(batch.column(1).to_pylist(), field)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            shas = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(every) for _, every in found], pa.string())
            added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, shas, spans, added],
                names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {counts}, base_sha256 string, spans string, n_added bigint")


def masked_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one, of the first kind."""
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, field: Field, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """`docs` with personal data masked in the text, and its length renewed where that column exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            texts = batch.column(place).to_pylist()
            new = [masked_text(t, every) for t, (_, every) in zip(texts, all_spans(texts, field))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    masked = docs.mapInArrow(run, docs.schema)
    return masked.withColumn(chars, F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[chars].dataType)) if chars in docs.columns else masked
