"""Operator 6: personal data by patterns and a character BiLSTM with CRF transitions.

The patterns give the base spans of a text.  A character-level bidirectional LSTM with a linear-chain
CRF on top is trained in numpy from labelled spans (the base spans of a bounded sample of texts, with
altered copies) and adds spans of the same kinds in other writings.  It reads overlapping windows around
all digits and at signs of the whole text, since no kind is written without one; windows are decoded
each for itself, and where two overlap each place takes the tag of the window that has it further inside.
A decoded span counts by its own CRF probability, against a limit calibrated on labelled texts left out of
the training; it must have the digits or parts of its kind, and never displaces a base span.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

KINDS = ("email", "ip", "card", "phone")
#: The bound of the fit: sampled distinct texts, code points read of each, zones without a span, and zones with a span
#: of each kind.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_WINDOWS, KIND_WINDOWS = 600, 20_000, 300, 150
WINDOW, STRIDE, REACH = 64, 32, 20
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 16, 16, 16, 0.02
#: One zone in so many is left out of the training; limits weighed up on those, and the share of spans found there
#: that may be wrong.
HELD_OUT, LIMITS, WRONG = 5, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95), 0.01

# ---- patterns ------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, from the
    at signs outwards, so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            out.append((start, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in email_spans(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- windows -------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]")
#: Symbols of the model: its own for each character of a number or an address, else a class.
_OWN = "@.-+() ,:;_%/=\"'\n"
_PAD, _DIGIT, _LOWER, _UPPER, _ALPHA, _REST = range(6)
SYMBOLS = 6 + len(_OWN)


def encode(text: str) -> np.ndarray:
    return np.array([6 + _OWN.index(c) if c in _OWN else _DIGIT if "0" <= c <= "9" else _LOWER if "a" <= c <= "z" else _UPPER if "A" <= c <= "Z"
                     else _ALPHA if c.isalpha() else _REST for c in text], dtype=np.int64)


def zones(text: str) -> list[tuple[int, int]]:
    """Maximal stretches within REACH code points of a digit or an at sign."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(zone: tuple[int, int]) -> list[tuple[int, int]]:
    """Overlapping windows that cover a zone."""
    a, b = zone
    starts = range(a, max(a + 1, b - (WINDOW - STRIDE)), STRIDE)
    return [(s, min(s + WINDOW, b)) for s in starts]


# ---- model ---------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind


def tags_of(spans: list[tuple[str, int, int]], start: int, end: int) -> np.ndarray:
    out = np.zeros(end - start, dtype=np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        for p in range(max(a, start), min(b, end)):
            out[p - start] = 1 + 2 * k + (p > a)
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]
    #: Least CRF probability of a span that counts.
    limit: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 7) -> "Tagger":
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED))}
        for side in "fb":
            w[f"in_{side}"] = rng.normal(0, 0.3, (EMBED + HIDDEN, 4 * HIDDEN))
            w[f"bias_{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS))
        w["out_bias"] = np.zeros(TAGS)
        w["move"] = np.zeros((TAGS, TAGS))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _lstm(self, x: np.ndarray, side: str, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: (time, batch, embed). Returns hidden states and what the backward pass needs."""
        w, bias = self.weights[f"in_{side}"], self.weights[f"bias_{side}"]
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((t, n, HIDDEN), np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = np.concatenate([x[k], h], 1)
            g = z @ w + bias
            i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN:2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN:3 * HIDDEN])
            a = np.tanh(g[:, 3 * HIDDEN:])
            m = mask[k][:, None]
            new = (f * c + i * a) * m
            kept.append((k, z, i, f, o, a, c, new, m))
            c = new
            h = o * np.tanh(c) * m
            out[k] = h
        return out, kept

    def _lstm_back(self, d_out: np.ndarray, kept: list, side: str, grads: dict) -> np.ndarray:
        w = self.weights[f"in_{side}"]
        n = d_out.shape[1]
        dx = np.zeros((d_out.shape[0], n, EMBED), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for k, z, i, f, o, a, c, new, m in reversed(kept):
            dh = (dh + d_out[k]) * m
            tc = np.tanh(new)
            dc = (dc + dh * o * (1 - tc * tc)) * m
            dg = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], 1)
            grads[f"in_{side}"] += z.T @ dg
            grads[f"bias_{side}"] += dg.sum(0)
            dz = dg @ w.T
            dx[k], dh, dc = dz[:, :EMBED], dz[:, EMBED:], dc * f
        return dx

    def emissions(self, symbols: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(time, batch) symbols -> (time, batch, tags) scores."""
        x = self.weights["embed"][symbols]
        forward, kept_f = self._lstm(x, "f", mask)
        backward, kept_b = self._lstm(x, "b", mask)
        both = np.concatenate([forward, backward], 2)
        return both @ self.weights["out"] + self.weights["out_bias"], (both, kept_f, kept_b)

    def marginals(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward of the CRF: log partition, tag marginals, and expected transitions."""
        whole, alpha, beta, expected = self.passes(scores, mask)
        return whole, np.exp(alpha + beta - whole[None, :, None]) * mask[:, :, None], expected

    def passes(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, forward and backward scores, and expected transitions."""
        t, n, k = scores.shape
        move = self.weights["move"]
        alpha, beta = np.zeros((t, n, k), np.float64), np.zeros((t, n, k), np.float64)
        alpha[0] = scores[0]
        for s in range(1, t):
            new = _lse(alpha[s - 1][:, :, None] + move, 1) + scores[s]
            alpha[s] = np.where(mask[s][:, None] > 0, new, alpha[s - 1])
        whole = _lse(alpha[-1], 1)
        expected = np.zeros((k, k))
        for s in range(t - 2, -1, -1):
            ahead = scores[s + 1] + beta[s + 1]
            new = _lse(move + ahead[:, None, :], 2)
            on = mask[s + 1][:, None] > 0
            beta[s] = np.where(on, new, beta[s + 1])
            pair = np.exp(alpha[s][:, :, None] + move + ahead[:, None, :] - whole[:, None, None])
            expected += (pair * on[:, :, None]).sum(0)
        return whole, alpha, beta, expected

    def gradients(self, symbols: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the gold tags, and its gradients."""
        scores, (both, kept_f, kept_b) = self.emissions(symbols, mask)
        whole, tags, expected = self.marginals(scores.astype(np.float64), mask)
        t, n = symbols.shape
        hot = np.eye(TAGS)[gold] * mask[:, :, None]
        moves = np.zeros((TAGS, TAGS))
        on = mask[1:] > 0
        np.add.at(moves, (gold[:-1][on], gold[1:][on]), 1)
        loss = (whole.sum() - (scores * hot).sum() - (self.weights["move"] * moves).sum()) / n
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        d = ((tags - hot) / n).astype(np.float32)
        grads["move"] = ((expected - moves) / n).astype(np.float32)
        grads["out"] = np.einsum("tnh,tnk->hk", both, d)
        grads["out_bias"] = d.sum((0, 1))
        d_both = d @ self.weights["out"].T
        dx = self._lstm_back(d_both[:, :, :HIDDEN], kept_f, "f", grads) + self._lstm_back(d_both[:, :, HIDDEN:], kept_b, "b", grads)
        np.add.at(grads["embed"], symbols, dx)
        return float(loss), grads

    def train(self, examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> list[float]:
        """Adam over batches of windows, at a rate that falls to a tenth; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            rate = RATE * (1 - 0.9 * epoch / epochs)
            order, total = rng.permutation(len(examples)), 0.0
            for a in range(0, len(order), BATCH):
                part = [examples[i] for i in order[a:a + BATCH]]
                loss, grads = self.gradients(*_padded([p[0] for p in part]), _padded([p[1] for p in part])[0])
                total += loss * len(part)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(examples))
        return losses

    def decode(self, pieces: list[np.ndarray]) -> list[tuple[np.ndarray, dict[tuple[int, int], float]]]:
        """Best tags of each window (Viterbi), and the CRF probability of each span (start, end) in them: that the
        places from start on have just these tags and the span ends at end."""
        symbols, mask = _padded(pieces)
        scores = self.emissions(symbols, mask)[0].astype(np.float64)
        move = self.weights["move"]
        t, n, _ = scores.shape
        best, back = scores[0], np.zeros(scores.shape, dtype=np.int8)
        for s in range(1, t):
            through = best[:, :, None] + move
            back[s] = through.argmax(1)
            new = through.max(1) + scores[s]
            on = mask[s][:, None] > 0
            back[s] = np.where(on, back[s], np.arange(TAGS))
            best = np.where(on, new, best)
        tags = np.zeros((t, n), dtype=np.int64)
        tags[-1] = best.argmax(1)
        for s in range(t - 1, 0, -1):
            tags[s - 1] = back[s][np.arange(n), tags[s]]
        whole, alpha, beta, _ = self.passes(scores, mask)
        out = []
        for j, p in enumerate(pieces):
            own, sure = tags[:len(p), j], {}
            for a, b in _tag_spans(own):
                inner = sum(move[own[q - 1], own[q]] + scores[q, j, own[q]] for q in range(a + 1, b))
                end = 0.0
                if b < len(p):
                    other = np.arange(TAGS) != own[a] + 1
                    end = _lse((move[own[b - 1]] + scores[b, j] + beta[b, j])[other], 0)
                sure[a, b] = float(np.exp(alpha[a, j, own[a]] + inner + end - whole[j]))
            out.append((own, sure))
        return out


def _tag_spans(tags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of a begin tag and its inside tags."""
    out = []
    for a in np.flatnonzero((tags > 0) & (tags % 2 == 1)).tolist():
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        out.append((a, b))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) values and mask."""
    t = max(len(r) for r in rows)
    out, mask = np.zeros((t, len(rows)), dtype=np.int64), np.zeros((t, len(rows)), dtype=np.float32)
    for j, r in enumerate(rows):
        out[:len(r), j], mask[:len(r), j] = r, 1
    return out, mask


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digits_like(piece: str, rng: np.random.Generator) -> str:
    return "".join(str(rng.integers(10)) if c.isdigit() else c for c in piece)


def _card_digits(rng: np.random.Generator) -> str:
    """Digits of a card number, the last so that they pass Luhn."""
    head = "".join(str(x) for x in rng.integers(0, 10, rng.choice([15, 15, 15, 16, 17, 18])))
    return next(head + c for c in "0123456789" if _luhn(head + c))


def written(kind: str, like: str | None, rng: np.random.Generator) -> str:
    """Personal data of a kind with other letters and numbers, in the writing of `like` or another one."""
    style = int(rng.integers(4)) if like else 1 + int(rng.integers(3))
    if kind == "email":
        name = lambda a, b: "".join(rng.choice(list(_LETTERS), int(rng.integers(a, b))))
        local = name(2, 9) + rng.choice(["", "", str(rng.integers(100)), "." + name(2, 8), "_" + name(2, 6)])
        host = rng.choice(["mail", name(3, 9)]) + rng.choice(["", str(rng.integers(30))])
        ending = "." + rng.choice(["com", "org", "net", "example.com", "co.uk", name(2, 4)])
        if style == 0:
            return "".join(rng.choice(list(_LETTERS)) if c in _LETTERS else str(rng.integers(10)) if c.isdigit() else c for c in like)
        return local + (" @ " if style == 1 and rng.integers(2) else "@") + host + ending
    if kind == "ip":
        dot = ["." if like else "[.]", ".", "[.]", "."][style]
        return dot.join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        d = _card_digits(rng)
        sign = str(rng.choice(["", " ", "-", "."], p=[0.4, 0.25, 0.2, 0.15])) if like is None or style else "".join(c for c in like if not c.isdigit())[:1]
        return sign.join(d[i:i + 4] for i in range(0, len(d), 4))
    if style == 0:
        return _digits_like(like, rng)
    a, b, c, d = ("".join(str(x) for x in rng.integers(0, 10, k)) for k in (int(rng.integers(1, 3)), 3, 3, 4))
    return [f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"+{a}-{b}-{c}-{d}"][int(rng.integers(5))]


def altered(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator, kind: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """A copy of a labelled window with its spans written anew, the first of them (if `kind` is given) as that kind."""
    out, marks, at = [], [], 0
    size = 0
    for was, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        now = was if kind is None or marks else kind
        piece = written(now, text[a:b] if now == was else None, rng)
        out += [text[at:a], piece]
        size += a - at
        marks.append((now, size, size + len(piece)))
        size += len(piece)
        at = b
    return "".join([*out, text[at:]]), marks


def _labelled_zones(texts: list[str]) -> tuple[list, list]:
    """(zones with spans, zones without), each as (text, spans).

    Numbers in the form of a card that fail Luhn are labelled too: the tagger learns the form, and decoded
    spans are held to Luhn."""
    labelled, plain = [], []
    for text in texts:
        spans = base_spans(text)
        spans += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(_digits(m.group())) <= 19 and not _luhn(_digits(m.group()))]
        for a, b in zones(text):
            inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
            (labelled if inside else plain).append((text[a:b], inside))
    return labelled, plain


def _calibrated(model: Tagger, held: list[tuple[str, list[tuple[str, int, int]]]]) -> float:
    """The lowest of LIMITS at which at most WRONG of the spans found in the labelled texts are wrong; the highest if
    there is none."""
    for limit in LIMITS:
        model.limit = limit
        found = added_spans([t for t, _ in held], [[] for _ in held], model)
        wrong = sum(not any(a < y and x < b for _, x, y in spans) for (_, spans), out in zip(held, found) for _, a, b in out)
        if wrong <= WRONG * sum(map(len, found)):
            return limit
    return LIMITS[-1]


def fit(texts: list[str], seed: int = 7) -> Tagger | None:
    """Train on the labelled zones of a bounded sample of texts; None where there is nothing to learn from.

    Every kind has the same number of zones: its own as they are and written anew, and zones of the others with its
    writings in their place."""
    rng = np.random.default_rng(seed)
    labelled, plain = _labelled_zones(texts)
    if not labelled:
        return None
    labelled = [labelled[i] for i in rng.permutation(len(labelled))]
    plain = [plain[i] for i in rng.permutation(len(plain))[:SAMPLE_WINDOWS]]
    learn = [z for i, z in enumerate(labelled) if i % HELD_OUT or len(labelled) < HELD_OUT]
    pool = []
    for kind in KINDS:
        own = [z for z in learn if any(k == kind for k, _, _ in z[1])][:KIND_WINDOWS // 2]
        pool += own
        for i in range(KIND_WINDOWS - len(own)):
            pool.append(altered(*learn[int(rng.integers(len(learn)))], rng, kind) if i % 2 or not own else altered(*own[int(rng.integers(len(own)))], rng))
    examples = []
    for text, spans in pool + [z for i, z in enumerate(plain) if i % HELD_OUT]:
        symbols, tags = encode(text), tags_of(spans, 0, len(text))
        for a, b in windows((0, len(text))):
            examples.append((symbols[a:b], tags[a:b]))
    model = Tagger.fresh(seed)
    model.train(examples, seed=seed)
    model.limit = _calibrated(model, [z for i, z in enumerate(labelled) if i % HELD_OUT == 0] + [z for i, z in enumerate(plain) if i % HELD_OUT == 0])
    return model


def _plausible(kind: str, piece: str) -> bool:
    """Whether a decoded span has the parts of its kind."""
    if kind == "email":
        return re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[^\s@]*\w", piece) is not None
    if kind == "ip":
        parts = piece.replace("[.]", ".").split(".")
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = _digits(piece)
    if re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", piece) is None:
        return False
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 8 <= len(digits) <= 15 and not (piece.isdecimal() and len(piece) > 12)


def _whole(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span extended over the number (an e-mail: the word) that it begins or ends in."""
    runs = str.isalnum if kind == "email" else str.isdecimal
    while a > 0 and runs(text[a]) and runs(text[a - 1]):
        a -= 1
    while b < len(text) and runs(text[b - 1]) and runs(text[b]):
        b += 1
    return a, b


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Tagger | None) -> list[list[tuple[str, int, int]]]:
    """Spans that the model adds to the base spans of each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    jobs = [(d, z, w) for d, text in enumerate(texts) for z in zones(text) for w in windows(z)]
    decoded: dict[tuple[int, tuple[int, int]], tuple[np.ndarray, np.ndarray, dict]] = {}
    for a in range(0, len(jobs), 256):
        part = jobs[a:a + 256]
        for (d, z, w), (tags, sure) in zip(part, model.decode([encode(texts[d][w[0]:w[1]]) for d, _, w in part])):
            # a place belongs to the window that has it furthest from its ends, and so does a span
            whole, depths, spans = decoded.setdefault((d, z), (np.zeros(z[1] - z[0], np.int64), np.full(z[1] - z[0], -1), {}))
            at = slice(w[0] - z[0], w[1] - z[0])
            place = np.arange(w[1] - w[0])
            depth = np.minimum(place if w[0] > z[0] else np.full_like(place, WINDOW), place[::-1] if w[1] < z[1] else np.full_like(place, WINDOW))
            better = depth > depths[at]
            whole[at], depths[at] = np.where(better, tags, whole[at]), np.where(better, depth, depths[at])
            for (s, e), p in sure.items():
                key, inside = (at.start + s, at.start + e, int(tags[s])), min(depth[s], depth[e - 1])
                if inside > spans.get(key, (-1, 0.0))[0]:
                    spans[key] = (inside, p)
    for (d, z), (tags, _, spans) in decoded.items():
        for s, e in _tag_spans(tags):
            name = KINDS[(int(tags[s]) - 1) // 2]
            a, b = _whole(name, texts[d], z[0] + s, z[0] + e)
            if name in ("card", "phone") and _plausible("ip", texts[d][a:b]):
                name = "ip"  # the tagger finds the number, its form tells the kind
            # a span that no window decoded as a whole has no probability of its own
            if spans.get((s, e, int(tags[s])), (0, 0.0))[1] >= model.limit and _plausible(name, texts[d][a:b]) and not any(x < b and a < y for _, x, y in base[d] + out[d]):
                out[d].append((name, a, b))
    return out


def all_spans(texts: list[str], model: Tagger | None) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """(base spans, all spans by kind and start) of each text."""
    base = [base_spans(t) for t in texts]
    added = added_spans(texts, base, model)
    return base, [sorted(b + a, key=lambda s: (KINDS.index(s[0]), s[1])) for b, a in zip(base, added)]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the union by the first's kind."""
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[at:a], f"<{kind.upper()}>"]
        last = at = max(last, b)
    return "".join([*out, text[at:]])


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """`fit` on SAMPLE_TEXTS distinct texts with a digit or an at sign: those of the smallest hashes, or all if there
    are fewer; however often a text is repeated, the driver gets one."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = rows.select(F.xxhash64("text", F.lit("pii")).alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    hashes = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).collect()]
    if not hashes:
        return None
    chosen = rows.where(F.col("h").isin(hashes)).groupBy("h").agg(F.min("text").alias("text"))
    return fit(sorted(r["text"] for r in chosen.collect()))


def _mapped(docs: DataFrame, model: Tagger | None, make, shape: str):
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in tb.text_slices(batch.column("text"), 1 << 20):
                part = batch.slice(first, end - first)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield make(part, texts, *all_spans(texts, held.value))

    return docs.mapInArrow(run, shape)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    n_<kind> count base spans; base_sha256 is the digest of the base spans, spans lists all, each as
    kind:start:end in code points.  Without a model one is trained on `docs`.

    A null text counts as empty (no spans).  Rows are independent: repeated rows and null ids are returned
    as they come; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = model or fit_on(rows)

    def make(part, texts, base, every):
        return pa.RecordBatch.from_arrays([
            part.column("doc_id"), *(pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS),
            pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([_joined(e) for e in every], pa.string()),
            pa.array([len(e) - len(b) for b, e in zip(base, every)], pa.int64()),
        ], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return _mapped(rows, model, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with every span in its text replaced by <KIND>; null texts stay null, other columns as they are."""
    model = model or fit_on(docs, text_col=text_col)
    other = [f for f in docs.schema if f.name != text_col]
    shape = ", ".join(["text string", *(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(other))])
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(other)])

    def make(part, texts, base, every):
        was = part.column("text").to_pylist()
        new = [None if w is None else redacted(t, e) for w, t, e in zip(was, texts, every)]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *part.columns[1:]], part.schema.names)

    out = _mapped(rows, model, make, shape)
    back = {f.name: f"c{i}" for i, f in enumerate(other)} | {text_col: "text"}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns])
