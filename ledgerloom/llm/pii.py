"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The base patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms and are
always kept. The model adds spans that they miss: spelled-out addresses, national phone numbers, cards with
unusual separators. It is trained in numpy in double precision, once per process, from labelled spans of a
seeded generator; texts are then read in single precision.

Every text is cut into overlapping windows, each of which gets its emission scores and its own Viterbi pass.
A document's spans are reconciled over all its windows: a span that a window sees whole goes before one that its edge cuts, of
whole ones that overlap the one farther from the edges stays, and spans longer than a window are put
together from the cut ones. Spans must hold up (digits, Luhn, parts up to 255) and must not touch a base
span. Windows go through in groups of `TOGETHER`, so memory beside the text itself is bounded.

Nothing is shuffled. Defined results: null or empty text has no spans; spans are code points with an
exclusive end; base kinds are leftmost and non-overlapping by themselves and may overlap each other;
repeated documents are scanned row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
import string
from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, utf8
from .secrets import joined_spans

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 256, 208
#: Line ends before and behind each text.
PAD = 16
#: Windows that are read together.
TOGETHER = 2048
HIDDEN, EMBEDDING = 12, 10
TRAIN_TEXTS, TRAIN_STEPS, TRAIN_BATCH, TRAIN_WINDOW = 4000, 400, 48, 80
SEED = 11

# Base patterns -------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits fails if the run's first digit does, so starts are tried at runs only.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
# Nothing follows the repeat, so it need not remember where it was: a long run of digits takes no memory then.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Around each @ the longest local part that no earlier match holds, and a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _ip_parts(text: str) -> bool:
    # Leading zeros don't count; a part of many digits is not turned into a number.
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind's index and end of the base matches."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_parts(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# Labelled spans ------------------------------------------------------------------------------------

_FILLER = "the report of and in was sent to for with from please see our new order on page until about total contact call reach me office line card host server item invoice".split()


def labelled_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with spans (start, kind's index, end), and texts with numbers that are no personal data."""
    rng = random.Random(seed)
    pick = rng.choice
    number = lambda k: f"{rng.randrange(10 ** k):0{k}}"
    letters = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8)))

    def card() -> str:
        digits = pick("3456") + number(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return pick([" ", "-", "", ".", "/"]).join(digits[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name, host, top = pick([letters(), letters() + pick(["", ".", "_"]) + letters()]), letters(), pick(["com", "org", "net", "de", "fr"])
        return pick([f"{name}@{host}.{top}", f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}[dot]{top}", f"{name} [at] {host}.{top}", f"{name}(at){host}.{top}"])

    def phone() -> str:
        return pick([
            f"+{number(2)} {number(3)} {number(3)} {number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"0{number(2)}-{number(3)}-{number(4)}",
            f"0{number(3)} {number(3)} {number(3)}", f"({number(3)}) {number(3)} {number(4)}", f"+{number(1)}-{number(3)}-{number(3)}-{number(4)}",
        ])

    def ip() -> str:
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    makers = (email, ip, card, phone)

    def harmless() -> str:
        return pick([
            f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{number(2)}.{number(2)}.20{number(2)}", f"{number(4)}", f"v{number(1)}.{number(1)}.{number(2)}",
            f"EUR {number(3)},{number(2)}", f"{number(5)}", f"#{number(7)}", f"{number(1)}.{number(3)}.{number(3)}", f"{number(3)} {number(2)}", f"{number(24)}", f"(at) {letters()}",
            f"20{number(2)}-{number(2)}-{number(2)} {number(2)}:{number(2)}:{number(2)}", f"{number(2)}/{number(2)}/20{number(2)}", f"{number(12)}", f"@{letters()}", f"{letters()}{number(6)}",
        ])

    out = []
    for _ in range(n):
        parts, spans, size = [], [], 0
        for _ in range(rng.randint(1, 3) if rng.random() < 0.2 else rng.randint(8, 21)):
            what = rng.random()
            kind = rng.randrange(4) if what < 0.14 else None
            piece = makers[kind]() if kind is not None else harmless() if what < 0.26 else pick(_FILLER) if what < 0.6 else letters()
            if kind is not None:
                spans.append((size, kind, size + len(piece)))
            piece += pick([" ", " ", " ", ", ", ". ", "\n", ": "])
            parts.append(piece)
            size += len(piece)
        out.append(("".join(parts), spans))
    return out


# Model ---------------------------------------------------------------------------------------------

# Characters are told apart as far as it matters: ASCII letters without case, digits as one, some signs.
_SIGNS = "@.+-()[]/: \n,#_%"
N_CHARS = 26 + 2 + len(_SIGNS) + 1
_CODES = np.full(128, N_CHARS - 1, dtype=np.uint8)
for _c in range(128):
    if chr(_c).isalpha():
        _CODES[_c] = ord(chr(_c).lower()) - 97
    elif chr(_c).isdigit():
        _CODES[_c] = 26
    elif chr(_c) in _SIGNS:
        _CODES[_c] = 28 + _SIGNS.index(chr(_c))
N_TAGS = 1 + 2 * len(KINDS)
# Inside k follows the beginning or the inside of k only.
_FORBIDDEN = np.array([[b > 0 and b % 2 == 0 and a not in (b - 1, b) for b in range(N_TAGS)] for a in range(N_TAGS)])


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], np.uint8(27))


def tags(n: int, spans) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    """x / sqrt(1 + x * x), which takes a fraction of the time of tanh; its slope is (1 - value ** 2) ** 1.5. Gates are
    half of it and a half."""
    return x / np.sqrt(1 + x * x)


def _slope(value: np.ndarray) -> np.ndarray:
    left = 1 - value * value
    return left * np.sqrt(left)


def _initial(seed: int) -> dict[str, np.ndarray]:
    """Parameters to begin with; those of the two directions are side by side in x, h and b."""
    rng = np.random.default_rng(seed)
    shapes = {"embed": (N_CHARS, EMBEDDING), "out": (2 * HIDDEN, N_TAGS), "out_b": (N_TAGS,), "move": (N_TAGS, N_TAGS), "begin": (N_TAGS,)}
    shapes |= {"x": (2, EMBEDDING, 4 * HIDDEN), "h": (2, HIDDEN, 4 * HIDDEN), "b": (2, 1, 4 * HIDDEN)}
    return {k: np.zeros(s) if k in ("out_b", "begin", "b") else rng.normal(0, 1 / np.sqrt(s[-2]), s) for k, s in shapes.items()}


def _lstm(p: dict, x: np.ndarray):
    """Hidden states (direction, time, row, HIDDEN) over x (direction, time, row, EMBEDDING), and what the gradient needs."""
    n_time, n_rows = x.shape[1:3]
    given = x @ p["x"][:, None] + p["b"][:, None]
    h = c = np.zeros((2, n_rows, HIDDEN))
    states, before, kept = np.empty((2, n_time, n_rows, HIDDEN)), np.empty((2, n_time, n_rows, HIDDEN)), []
    for t in range(n_time):
        squashed = _squash(given[:, t] + h @ p["h"])
        gates, g = 0.5 + 0.5 * squashed[..., : 3 * HIDDEN], squashed[..., 3 * HIDDEN :]
        i, f, o = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        new = f * c + i * g
        out = _squash(new)
        kept.append((c, i, f, o, g, squashed, out))
        before[:, t] = h
        h, c = o * out, new
        states[:, t] = h
    return states, (before, kept)


def _lstm_gradient(p: dict, x: np.ndarray, before: np.ndarray, kept, d_states: np.ndarray, grad: dict) -> np.ndarray:
    n_time, n_rows = x.shape[1:3]
    d_gates, d_h, d_c, back = np.empty((2, n_time, n_rows, 4 * HIDDEN)), 0, 0, p["h"].transpose(0, 2, 1)
    for t in reversed(range(n_time)):
        c, i, f, o, g, squashed, out = kept[t]
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * _slope(out)
        d_gates[:, t] = np.concatenate((0.5 * d_c * g, 0.5 * d_c * c, 0.5 * d_h * out, d_c * i), axis=-1) * _slope(squashed)
        d_h, d_c = d_gates[:, t] @ back, d_c * f
    flat = d_gates.reshape(2, -1, 4 * HIDDEN)
    grad["x"] = x.reshape(2, -1, EMBEDDING).transpose(0, 2, 1) @ flat
    grad["h"] = before.reshape(2, -1, HIDDEN).transpose(0, 2, 1) @ flat
    grad["b"] = flat.sum(axis=1, keepdims=True)
    return d_gates @ p["x"].transpose(0, 2, 1)[:, None]


def emissions(p: dict, rows: np.ndarray):
    """Scores (time, row, tag) for rows of character codes (row, time)."""
    x = p["embed"][rows.T]
    x = np.stack((x, x[::-1]))
    states, kept = _lstm(p, x)
    both = np.concatenate((states[0], states[1, ::-1]), axis=2)
    return both @ p["out"] + p["out_b"], (x, both, *kept)


def _loss_gradient(p: dict, rows: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood of the gold tags under the CRF, by row, and its gradient."""
    scores, (x, both, before, kept) = emissions(p, rows)
    (n_time, n_rows), gold, row = scores.shape[:2], gold.T, np.arange(rows.shape[0])
    # Forward and backward recursion, scaled at each time so that the forward values sum to 1.
    top = scores.max(axis=2, keepdims=True)
    e, move = np.exp(scores - top), np.exp(p["move"])
    alpha, scale, beta = np.empty_like(e), np.empty((n_time, n_rows, 1)), np.ones_like(e)
    for t in range(n_time):
        at = (alpha[t - 1] @ move if t else np.exp(p["begin"])) * e[t]
        scale[t] = at.sum(axis=1, keepdims=True)
        alpha[t] = at / scale[t]
    ahead = e / scale
    for t in reversed(range(1, n_time)):
        ahead[t] *= beta[t]
        beta[t - 1] = ahead[t] @ move.T
    time = np.arange(n_time)[:, None]
    total = (np.log(scale) + top).sum(axis=0)[:, 0]
    value = total - p["begin"][gold[0]] - scores[time, row, gold].sum(axis=0) - p["move"][gold[:-1], gold[1:]].sum(axis=0)
    d_scores = alpha * beta
    d_scores[time, row, gold] -= 1
    grad = {"move": move * (alpha[:-1].reshape(-1, N_TAGS).T @ ahead[1:].reshape(-1, N_TAGS)), "begin": d_scores[0].sum(axis=0)}
    np.subtract.at(grad["move"], (gold[:-1], gold[1:]), 1)
    flat = d_scores.reshape(-1, N_TAGS)
    grad["out"], grad["out_b"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
    d_both = d_scores @ p["out"].T
    d_x = _lstm_gradient(p, x, before, kept, np.stack((d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:])), grad)
    d_x = (d_x[0] + d_x[1, ::-1]).reshape(-1, EMBEDDING)
    grad["embed"] = (rows.T.reshape(-1, 1) == np.arange(N_CHARS)).T.astype(float) @ d_x
    return float(value.mean()), {k: v / n_rows for k, v in grad.items()}


@functools.lru_cache(maxsize=2)
def trained(n_texts: int = TRAIN_TEXTS, steps: int = TRAIN_STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters after Adam over windows of the labelled texts; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    # Windows run over both ends of texts, filled up with line ends as in scan_texts.
    fill = TRAIN_WINDOW // 2
    texts = [(codes("\n" * fill + t + "\n" * fill), tags(len(t) + 2 * fill, [(a + fill, k, b + fill) for a, k, b in s])) for t, s in labelled_texts(n_texts, seed)]
    texts = [(c, g) for c, g in texts if len(c) > TRAIN_WINDOW]
    p = _initial(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows, gold = [], []
        for i in rng.integers(0, len(texts), TRAIN_BATCH):
            at = int(rng.integers(0, len(texts[i][0]) - TRAIN_WINDOW))
            rows.append(texts[i][0][at : at + TRAIN_WINDOW])
            gold.append(texts[i][1][at : at + TRAIN_WINDOW])
        _, grad = _loss_gradient(p, np.stack(rows), np.stack(gold))
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / size)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6))
    return p


class Tagger:
    """The trained parameters as a group of windows needs them: gate by gate, both directions side by side, characters
    straight to gates. States are kept at twice their value, so that gates need no halves; the weights they meet are
    halved."""

    def __init__(self, p: dict) -> None:
        def by_gate(x: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(np.stack(np.split(x, 4, axis=-1)), dtype=np.float32)

        self.by_char, self.hidden = by_gate(p["embed"] @ p["x"] + p["b"]), by_gate(p["h"] / 2)
        self.out, self.out_b = np.ascontiguousarray(p["out"].T / 2, dtype=np.float32), p["out_b"].astype(np.float32)
        self.begin, self.move = p["begin"].astype(np.float32), np.where(_FORBIDDEN, -1e4, p["move"]).astype(np.float32)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Emission scores (time, tag, row) for rows of character codes (row, time)."""
        n, width = rows.shape
        states = np.empty((2, width, n, HIDDEN), dtype=np.float32)
        h, c, root = (np.zeros((2, n, HIDDEN), dtype=np.float32) for _ in range(3))
        gates, size = (np.empty((4, 2, n, HIDDEN), dtype=np.float32) for _ in range(2))
        columns = np.ascontiguousarray(rows.T)
        for t in range(width):
            np.matmul(h, self.hidden, out=gates)
            for k in range(4):
                gates[k, 0] += self.by_char[k, 0].take(columns[t], axis=0)
                gates[k, 1] += self.by_char[k, 1].take(columns[width - 1 - t], axis=0)
            np.multiply(gates, gates, out=size)
            size += 1
            np.sqrt(size, out=size)
            gates /= size
            gates[:3] += 1
            i, f, o, g = gates
            i *= g
            # Half of what the cell was and what comes in is the new cell.
            c *= f
            c += i
            c *= 0.5
            np.multiply(c, c, out=root)
            root += 1
            np.sqrt(root, out=root)
            np.divide(c, root, out=h)
            h *= o
            states[0, t], states[1, width - 1 - t] = h
        out = np.matmul(self.out[:, :HIDDEN], states[0].transpose(0, 2, 1))
        out += np.matmul(self.out[:, HIDDEN:], states[1].transpose(0, 2, 1))
        out += self.out_b[:, None]
        return out

    def tags(self, rows: np.ndarray) -> np.ndarray:
        """Best tags (row, time) of each row by itself."""
        return viterbi(self.begin, self.move, self.scores(rows))


def viterbi(begin: np.ndarray, move: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Best tags (row, time) for scores (time, tag, row), all in single precision."""
    n_time, _, n = scores.shape
    best, reached = np.empty_like(scores), np.empty_like(scores[0])
    best[0] = begin[:, None] + scores[0]
    none = best[0, 0].copy()
    for t in range(1, n_time):
        at, most = best[t - 1], best[t]
        np.add(at[0], move[0][:, None], out=most)
        for a in range(1, N_TAGS):
            np.add(at[a], move[a][:, None], out=reached)
            np.maximum(most, reached, out=most)
        most += scores[t]
        none += move[0, 0]
        none += scores[t, 0]
    # Most rows have no span: their best value is that of no tag at all, summed in the same order.
    out = np.zeros((n_time, n), dtype=np.int64)
    last = best[-1].argmax(axis=0)
    some = np.flatnonzero((last > 0) | (best[-1, 0] != none))
    best, into = np.ascontiguousarray(best[:, :, some].transpose(0, 2, 1)), np.ascontiguousarray(move.T)
    tag = last[some]
    out[-1, some] = tag
    for t in reversed(range(1, n_time)):
        tag = (best[t - 1] + into.take(tag, axis=0)).argmax(axis=1)
        out[t - 1, some] = tag
    return out.T


# Windows -------------------------------------------------------------------------------------------


def _holds_up(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[(\[] ?at ?[)\]]) ?[\w-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[\w-]+)+", text, re.IGNORECASE))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text)) and _ip_parts(text)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9() .-]*[0-9]", text)) and len(digits) < len(text)


def windows(text: str):
    """Start (PAD before the text at first) and character codes of each window."""
    last = max(0, -(-(len(text) + 2 * PAD - WINDOW) // STRIDE)) if text else -1
    per = 4096
    for low in range(0, last + 1, per):
        high = min(last + 1, low + per)
        begin, end = low * STRIDE - PAD, (high - 1) * STRIDE - PAD + WINDOW
        part = np.full(end - begin, _CODES[10], dtype=np.uint8)
        own = codes(text[max(begin, 0) : end])
        part[max(0, -begin) : max(0, -begin) + len(own)] = own
        for k in range(low, high):
            yield k * STRIDE - PAD, part[(k - low) * STRIDE : (k - low) * STRIDE + WINDOW]


@dataclass(frozen=True)
class _Seen:
    """A span as one window sees it: whether the window's edges cut it, and how far they are."""

    start: int
    kind: int
    end: int
    cut_left: bool
    cut_right: bool
    depth: int


def _seen(text: str, window: int, found: np.ndarray) -> list[_Seen]:
    out = []
    for i in np.flatnonzero(found % 2 == 1).tolist():
        j = i + 1
        while j < len(found) and found[j] == found[i] + 1:
            j += 1
        start, end, right = max(window + i, 0), min(window + j, len(text)), window + WINDOW
        cut_left, cut_right = i == 0 and window > 0, j == WINDOW and right < len(text)
        while end > start and not cut_right and text[end - 1] in " \n.,:-":
            end -= 1
        if end > start:
            out.append(_Seen(start, int(found[i]) // 2, end, cut_left, cut_right, min(i if window > 0 else WINDOW, WINDOW - j if right < len(text) else WINDOW)))
    # A window may also begin inside a span.
    if found[0] and found[0] % 2 == 0 and window > 0:
        j = int(np.argmax(found != found[0])) if (found != found[0]).any() else WINDOW
        out.append(_Seen(window, int(found[0]) // 2 - 1, min(window + j, len(text)), True, j == WINDOW and window + WINDOW < len(text), 0))
    return out


def _reconciled(seen: list[_Seen]) -> list[tuple[int, int, int]]:
    """One list of spans that don't overlap, from what all windows of a text saw."""
    whole, cut = [x for x in seen if not (x.cut_left or x.cut_right)], sorted((x for x in seen if x.cut_left or x.cut_right), key=lambda x: (x.start, x.end))
    starts: list[int] = []
    taken: dict[int, _Seen] = {}

    def put(x: _Seen) -> None:
        i = bisect(starts, x.start)
        if not (i and taken[starts[i - 1]].end > x.start) and not (i < len(starts) and starts[i] < x.end):
            starts.insert(i, x.start)
            taken[x.start] = x

    for x in sorted(set(whole), key=lambda x: (-x.depth, x.start, x.kind)):
        put(x)
    long: list[_Seen] = []
    for x in cut:
        if long and long[-1].kind == x.kind and x.start < long[-1].end:
            y = long[-1]
            right = x if x.end > y.end else y
            long[-1] = _Seen(y.start, y.kind, right.end, y.cut_left and (x.cut_left or x.start > y.start), right.cut_right, 0)
        else:
            long.append(x)
    for x in long:
        if not (x.cut_left or x.cut_right):
            put(x)
    return [(x.start, x.kind, x.end) for x in taken.values()]


def scan_texts(tagger: Tagger, texts: list[str]):
    """For each text its spans: start, kind's index, end and what found it (base or model)."""
    rows: list[np.ndarray] = []
    places: list[tuple[int, int]] = []
    seen: dict[int, list[_Seen]] = {}

    def flush() -> None:
        if rows:
            found = tagger.tags(np.stack(rows))
            for w in np.flatnonzero(found.any(axis=1)).tolist():
                i, start = places[w]
                seen.setdefault(i, []).extend(_seen(texts[i], start, found[w]))
            rows.clear()
            places.clear()

    for i, text in enumerate(texts):
        for start, row in windows(text):
            rows.append(row)
            places.append((i, start))
            if len(rows) == TOGETHER:
                flush()
    flush()
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        more = [x for x in _reconciled(seen.pop(i, [])) if _holds_up(x[1], text[x[0] : x[2]])]
        if more and base:
            taken = np.zeros(len(text), dtype=bool)
            for s, _, e in base:
                taken[s:e] = True
            more = [(s, k, e) for s, k, e in more if not taken[s:e].any()]
        out.append(sorted([(s, k, e, "base") for s, k, e in base] + [(s, k, e, "model") for s, k, e in more]))
    return out


def _by_bytes(batch: pa.RecordBatch, most: int = 8 << 20):
    """The rows of a batch in slices of 500 at most, and of about so many bytes."""
    ends, begin = np.cumsum([len(t) for t in utf8(batch.column(1))]), 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = min(begin + 500, max(begin + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans, an array of kind, start, end and finder by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(Tagger(trained()))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("finder", pa.string())])

    def scan(batches):
        for batch in arrow_batches(batches):
            for small in _by_bytes(batch):
                found = scan_texts(shared.value, [t.decode() for t in utf8(small.column(1))])
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "finder": f} for s, k, e, f in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,finder:string>>")


def personal_digest(found: DataFrame) -> DataFrame:
    """The columns of query op4, from what find_personal_data returns."""
    base = F.filter("spans", lambda s: s["finder"] == "base")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> list[tuple[int, str, int]]:
    """The base spans of a text (start, kind, end) by the patterns as they are stated; for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]
