"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy on labelled spans made by a seeded generator:
plain and disguised emails, addresses, card and phone numbers and secrets among
words and look-alikes such as dates, prices, versions and hashes. A text is read
in overlapping windows wherever it holds evidence: a digit, "@", an "at" or
"dot" in brackets, the word "dot", or a key that names a secret. Scores of windows
that overlap are blended, and one best path through the CRF over the whole
stretch reconciles them, so a span is not cut where a window ends. A span other
than a secret holds evidence itself.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
#: Number of the kind that has no base pattern, and tags (outside, then begin and inside of each kind).
SECRET, TAGS = 4, 11
#: Window length and step, hidden units, codes of characters.
WINDOW, STEP, HIDDEN, CODES = 96, 48, 24, 130
#: Training: steps, windows a step, rate, seed; least mean posterior of a span.
STEPS, BATCH, RATE, SEED, CONFIDENCE = 600, 64, 0.015, 5, 0.65
#: Windows read at once; characters of one decoded part, of a padded batch of them, and of the stretches handled together.
DECODE, LONGEST, CELLS, MOST = 1024, 4096, 200_000, 1_000_000
EVIDENCE = re.compile(r"[0-9@]|[(\[{<]\s?(?:at|dot)\s?[)\]}>]|\bdot\b|(?:passw|secret|token|key)\w*[\"']?\s?[=:]", re.I)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails, in time linear in the text: from each "@" back to where its local part begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
        done = match.end() if match else done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four runs of digits joined by single dots; a match with a part over 255 is dropped and not retried."""
    chain: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        if chain and not (m.start() == chain[-1][1] + 1 and text[m.start() - 1] == "."):
            chain = []
        chain.append(m.span())
        if len(chain) == 4:
            if all(b - a < 4 or not text[a:b].lstrip("0")[3:] for a, b in chain) and all(int(text[a:b].lstrip("0") or "0") <= 255 for a, b in chain):
                yield chain[0][0], chain[3][1]
            chain = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed and then start."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(1, *s) for s in addresses(text)] + [(2, *s) for s in cards(text)] + [(3, *s) for s in phones(text)]
    return found


# ---- labelled spans ------------------------------------------------------------------------------------------------

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def codes(text: str) -> np.ndarray:
    """Characters as 0..129: ASCII, other letters 128, other characters 129 (all beyond the basic plane among them)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, c, np.where(_LETTER[np.minimum(c, 0xFFFF)] & (c <= 0xFFFF), 128, 129)).astype(np.int64)


class Maker:
    """Seeded generator of labelled text: pieces with personal data or secrets in plain and disguised forms, among words and look-alikes."""

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.random.choices("0123456789", k=n))

    def hexes(self, n: int) -> str:
        return "".join(self.random.choices("0123456789abcdef", k=n))

    def word(self) -> str:
        r = self.random
        made = "".join(r.choices("aaeeiioouubcdfghjklmnpqrstvwxyzß" if r.random() < 0.1 else "aeiouaeioubcdfghlmnprstvwz", k=r.randrange(2, 10)))
        if r.random() < 0.12:
            made = "".join(r.choices("éèêñóíüöäçß", k=r.randrange(1, 4))) + made
        roll = r.random()
        return made.capitalize() if roll < 0.12 else made.upper() if roll < 0.2 else made

    def email(self) -> str:
        r = self.random
        plain = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 11)))
        name = r.choice((".", "_", "-", "")).join(plain() for _ in range(r.choice((1, 1, 2, 2, 3)))) + r.choice(("", "", self.digits(2), "." + self.digits(2)))
        host = [plain() + r.choice(("", "", self.digits(1))) for _ in range(r.choice((1, 1, 1, 2)))] + [r.choice(("com", "org", "net", "de", "fr", "edu", "io", "example", "info"))]
        if r.random() < 0.3:
            return f"{name}@{'.'.join(host)}"
        at = r.choice(("(at)", "[at]", "{at}", "(AT)", "[AT]", "<at>", "@", "at"))
        dot = "dot" if at == "at" else r.choice((".", ".", "(dot)", "[dot]", "{dot}", "(DOT)", "dot"))
        gap = " " if at == "at" or at == "@" else r.choice((" ", " ", ""))
        between = "." if dot == "." else f" {dot} " if dot == "dot" else r.choice((" ", "")) .join(("", dot, ""))
        return f"{name}{gap}{at}{gap}{between.join(host)}"

    def ip(self) -> str:
        return self.random.choice((".", ".", "[.]", "(.)", " . ", "[dot]", " dot ")).join(str(self.random.randrange(256)) for _ in range(4))

    def card(self) -> str:
        body = self.digits(16)  # whether its check digit is right is for ``counted`` to say
        gap = self.random.choice(("", "", " ", "-", ".", "  ", "/", "_"))
        return gap.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        d, r = self.digits, self.random
        return r.choice((
            lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)}{d(10)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"00{d(2)} {d(3)} {d(6)}",
            lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)}/{d(7)}",
        ))()

    def secret(self) -> tuple[str, str, str]:
        """What stands before the secret, the secret, and what stands after it."""
        r = self.random
        value = r.choice((lambda: self.hexes(r.randrange(12, 41)), lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!_-", k=r.randrange(8, 33)))))()
        if r.random() < 0.25:
            return "", r.choice((lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), lambda: "ghp_" + "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=36)), lambda: "sk-" + self.hexes(32)))(), ""
        key = r.choice(("password", "passwd", "Password", "PASSWORD", "token", "secret", "api_key", "apikey", "access_token", "auth_token", "secret_key"))
        quote = r.choice(("", '"', "'"))
        return key + r.choice(("=", ": ", " = ", ":")) + quote, value, quote

    def other(self) -> str:
        d, r = self.digits, self.random
        n = r.randrange(22)
        if n < 2:
            return f"{d(4)}-{d(2)}-{d(2)}"
        if n < 8:
            return (f"${d(3)}.{d(2)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"@{self.word()}", f"({d(2)})")[n - 2]
        if n < 11:
            return d(r.randrange(1, 8))
        if n < 14:
            return self.hexes(r.randrange(12, 65))
        if n == 14:
            return r.choice(("count", "size", "id", "line", "page", "x")) + r.choice(("=", ": ", " = ")) + d(r.randrange(1, 6))
        if n == 15:
            return ".".join(d(1) for _ in range(r.randrange(5, 8)))
        if n == 16:
            return f"https://{self.word()}.{r.choice(('com', 'org'))}/{self.word()}/{d(3)}"
        if n == 17:
            return r.choice((f"{d(3)},{d(3)}", f"{d(2)}%", f"v{d(1)}.{d(2)}", f"{d(3)}-{d(2)}", "Version 2.0", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "3.0 License"))
        if n == 18:
            return r.choice(("at", "dot", "(at)", "at the dot", "token", "the password is", "key", "a token of", "look at"))
        if n == 19:
            return d(r.randrange(20, 40))
        if n == 20:
            return "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=r.randrange(8, 21)))
        return f"{self.word()}@{d(2)}"

    def text(self, least: int) -> tuple[str, list[int]]:
        """At least ``least`` characters with their tags."""
        r, made, tags = self.random, [], []
        end = r.choice(("", "", "", "", "!!", "$$$", "###", "%%%", "&&&", "***", " |"))
        size = 0

        def put(piece: str, kind: int | None = None) -> None:
            nonlocal size
            made.append(piece)
            size += len(piece)
            tags.extend([0] * len(piece) if kind is None or not piece else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1))

        while size < least:
            roll = r.random()
            if roll < 0.2:
                kind = r.randrange(5)
                for _ in range(1 + (r.random() < 0.1)):  # sometimes two in a row
                    if kind == 4:
                        before, value, after = self.secret()
                        put(before), put(value, 4), put(after)
                    else:
                        put((self.email, self.ip, self.card, self.phone)[kind](), kind)
                    put(r.choice((end, end, "", ",", ".")) + " ")
                    if r.random() < 0.4:
                        kind = r.randrange(5)
                continue
            if roll < 0.36:
                put(self.other())
            else:
                for _ in range(r.randrange(1, 6)):
                    put(self.word() + end + r.choice((" ", " ", " ", " ", ", ", ". ", "\n", ".\n")))
                continue
            put(r.choice((end, end, ",", ".")) + r.choice((" ", " ", "\n")))
        return "".join(made), tags


def labelled(maker: Maker, windows: int, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Training windows, cut from one text in a row: character codes and tags (windows, length)."""
    text, tags = maker.text(windows * length + 60)
    cut = maker.random.randrange(60)
    n = windows * length
    return codes(text)[cut : cut + n].reshape(windows, length), np.array(tags[cut : cut + n], np.int64).reshape(windows, length)


# ---- the network ---------------------------------------------------------------------------------------------------

#: Transitions that cannot happen: to the inside of a kind from anything but that kind.
_FORBIDDEN = np.array([[j > 0 and j % 2 == 0 and i not in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _inputs(x: np.ndarray) -> np.ndarray:
    """Rows of the input weights (neighbour, direction, windows, time) for codes (windows, time): a character's own and those of its neighbours, spaces beyond the ends."""
    wide = np.pad(x, ((0, 0), (1, 1)), constant_values=32)
    near = np.stack([wide[:, 1:-1], wide[:, :-2], wide[:, 2:]])
    both = np.stack([near, near[:, :, ::-1] + CODES], 1)
    return both + (np.arange(len(near)) * 2 * CODES)[:, None, None, None]


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool = False):
    """Hidden states (time, direction, windows, units) of both directions, side by side, for codes (windows, time); each in its own order of time. With ``keep`` also what backpropagation needs."""
    n, steps = x.shape
    rows = _inputs(x)
    h, c = np.zeros((2, n, HIDDEN), wx.dtype), np.zeros((2, n, HIDDEN), wx.dtype)
    out, saved = np.empty((steps, 2, n, HIDDEN), wx.dtype), []
    for t in range(steps):
        z = wx[rows[0, :, :, t]] + wx[rows[1, :, :, t]] + wx[rows[2, :, :, t]] + h @ wh
        gates = _sigmoid(z[:, :, : 3 * HIDDEN])
        i, f, o = gates[:, :, :HIDDEN], gates[:, :, HIDDEN : 2 * HIDDEN], gates[:, :, 2 * HIDDEN :]
        g = np.tanh(z[:, :, 3 * HIDDEN :])
        before_c, before_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((gates, g, before_c, before_h, tc))
    return out, (rows, saved)


def _lstm_back(d_out: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    rows, saved = kept
    steps, _, n, _ = d_out.shape
    each, befores = np.empty((2, steps, n, 4 * HIDDEN), wx.dtype), np.empty((2, steps, n, HIDDEN), wx.dtype)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    back = wh.transpose(0, 2, 1).copy()
    for t in range(steps - 1, -1, -1):
        gates, g, before_c, before_h, tc = saved[t]
        i, f, o = gates[:, :, :HIDDEN], gates[:, :, HIDDEN : 2 * HIDDEN], gates[:, :, 2 * HIDDEN :]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g, dc * before_c, dh * tc, dc * i * (1 - g * g)], 2)
        dz[:, :, : 3 * HIDDEN] *= gates * (1 - gates)
        each[:, t], befores[:, t] = dz, before_h
        dh, dc = dz @ back, dc * f
    flat = each.reshape(2, steps * n, 4 * HIDDEN)
    d_wx = np.zeros_like(wx)
    for near in rows:
        used = near.transpose(0, 2, 1).ravel()
        order = np.argsort(used, kind="stable")
        values, starts = np.unique(used[order], return_index=True)
        d_wx[values] = np.add.reduceat(flat.reshape(-1, 4 * HIDDEN)[order], starts, axis=0)
    return d_wx, befores.reshape(2, steps * n, HIDDEN).transpose(0, 2, 1) @ flat


def _marginals(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores (time, rows, tags): log partition, tag marginals, and expected transition counts. A row ends after its size, if sizes are given."""
    steps, n, k = scores.shape
    live = np.ones((steps, n, 1), bool) if sizes is None else (np.arange(steps)[:, None] < sizes[None, :])[:, :, None]
    fwd, bwd = np.empty_like(scores), np.zeros_like(scores)
    e = np.exp(trans).astype(scores.dtype)
    fwd[0] = scores[0]
    for t in range(1, steps):
        m = fwd[t - 1].max(1, keepdims=True)
        fwd[t] = np.where(live[t], scores[t] + m + np.log(np.exp(fwd[t - 1] - m) @ e + 1e-30), fwd[t - 1])
    for t in range(steps - 2, -1, -1):
        y = scores[t + 1] + bwd[t + 1]
        m = y.max(1, keepdims=True)
        bwd[t] = np.where(live[t + 1], m + np.log(np.exp(y - m) @ e.T + 1e-30), bwd[t + 1])
    m = fwd[-1].max(1, keepdims=True)
    z = (m + np.log(np.exp(fwd[-1] - m).sum(1, keepdims=True)))[:, 0]
    p = np.exp(fwd + bwd - z[None, :, None])
    pairs = np.zeros((k, k))
    if sizes is None:
        for t in range(steps - 1):
            a, b = np.exp(fwd[t] - fwd[t].max(1, keepdims=True)), scores[t + 1] + bwd[t + 1]
            b = np.exp(b - b.max(1, keepdims=True))
            norm = ((a @ e) * b).sum(1)
            pairs += e * ((a / norm[:, None]).T @ b)
    return z, p, pairs


def _viterbi(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Best tags (rows, time) of scores (time, rows, tags). A row ends after its size, if sizes are given; what follows repeats its last tag."""
    steps, n, k = scores.shape
    live = np.ones((steps, n), bool) if sizes is None else np.arange(steps)[:, None] < sizes[None, :]
    best, back = scores[0], np.empty((steps, n, k), np.int8)
    own = np.arange(k, dtype=np.int8)[None, :]
    for t in range(1, steps):
        total = best[:, :, None] + trans[None]
        at = total.argmax(1)
        now = np.take_along_axis(total, at[:, None, :], 1)[:, 0] + scores[t]
        back[t] = np.where(live[t][:, None], at, own)
        best = np.where(live[t][:, None], now, best)
    tags = np.empty((n, steps), np.int8)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = np.take_along_axis(back[t], tags[:, t][:, None].astype(np.int64), 1)[:, 0]
    return tags


@dataclass(frozen=True)
class Tagger:
    """Weights of the two directions (inputs by neighbour and code, recurrent), the output layer and the transitions."""

    wx: np.ndarray
    wh: np.ndarray
    out: np.ndarray
    trans: np.ndarray

    def hidden(self, x: np.ndarray, keep: bool = False):
        states, kept = _lstm(x, self.wx, self.wh, keep)
        return np.concatenate([states[:, 0], states[::-1, 1]], 2), kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, windows, tags) of codes (windows, time)."""
        return self.hidden(x)[0] @ self.out[:-1] + self.out[-1]


@functools.cache
def train(steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Tagger:
    """A tagger trained by Adam on the CRF likelihood of generated labelled spans; the same for the same arguments, and made once a process."""
    rng, maker = np.random.default_rng(seed), Maker(seed)
    weights = [rng.normal(0, 0.2, (6 * CODES, 4 * HIDDEN)), rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), rng.normal(0, 0.2, (2 * HIDDEN + 1, TAGS)), np.zeros((TAGS, TAGS))]
    weights = [w.astype(np.float32) for w in weights]
    weights[0][: 2 * CODES, HIDDEN : 2 * HIDDEN] += 1
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        x, y = labelled(maker, batch)
        trans = np.where(_FORBIDDEN, np.float32(-30), weights[3])
        hidden, kept = Tagger(*weights).hidden(x, True)
        scores = hidden @ weights[2][:-1] + weights[2][-1]
        _, p, pairs = _marginals(scores, trans)
        gold = np.zeros_like(p)
        np.put_along_axis(gold, y.T[:, :, None], 1, 2)
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d = (p - gold) / np.float32(batch)
        d_hidden = d @ weights[2][:-1].T
        grads = [*_lstm_back(np.stack([d_hidden[:, :, :HIDDEN], d_hidden[::-1, :, HIDDEN:]], 1), weights[0], weights[1], kept)]
        flat = d.reshape(-1, TAGS)
        grads += [np.concatenate([hidden.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)[None]]), np.where(_FORBIDDEN, 0, (pairs - seen) / batch)]
        norm = np.sqrt(sum((g**2).sum() for g in grads))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * (step - 1) / steps))
        for i, g in enumerate(grads):
            g = (g * min(1.0, 5.0 / norm)).astype(np.float32)
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            weights[i] = (weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Tagger(*weights[:3], np.where(_FORBIDDEN, -1e4, weights[3]).astype(np.float32))


# ---- whole texts ---------------------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches (start, end) of whole windows, of which there is one every STEP characters, around evidence: each piece of evidence lies in two windows, and windows that meet are one stretch."""
    out: list[tuple[int, int]] = []
    for m in EVIDENCE.finditer(text):
        first, last = max(0, (m.start() - WINDOW) // STEP + 1) * STEP, min(len(text), m.start() // STEP * STEP + WINDOW)
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def blended(pieces: list[np.ndarray], tagger: Tagger) -> list[np.ndarray]:
    """For each stretch of codes its scores (time, tags): those of its overlapping windows, weighted by a character's distance from a window's ends."""
    jobs = [(n, s) for n, x in enumerate(pieces) for s in ([0] if len(x) <= WINDOW else sorted({min(s, len(x) - WINDOW) for s in range(0, len(x) - WINDOW + STEP, STEP)}))]
    total, weight = [np.zeros((len(x), TAGS), np.float32) for x in pieces], [np.zeros((len(x), 1), np.float32) for x in pieces]
    ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    for at in range(0, len(jobs), DECODE):
        part = jobs[at : at + DECODE]
        x = np.full((len(part), WINDOW), 32, np.int64)
        for i, (n, s) in enumerate(part):
            own = pieces[n][s : s + WINDOW]
            x[i, : len(own)] = own
        scores = tagger.scores(x)
        for i, (n, s) in enumerate(part):
            size = min(WINDOW, len(pieces[n]) - s)
            total[n][s : s + size] += scores[:size, i] * ramp[:size]
            weight[n][s : s + size] += ramp[:size]
    return [t / w for t, w in zip(total, weight, strict=True)]


def _cuts(scores: np.ndarray) -> list[int]:
    """Where a stretch is cut so that no decoded part is longer than LONGEST: in the last quarter of each part, at the character that is most surely outside."""
    out, at = [0], 0
    outside = scores[:, 0] - scores[:, 1:].max(1)
    while len(scores) - at > LONGEST:
        low = at + LONGEST * 3 // 4
        at = low + int(np.argmax(outside[low : at + LONGEST]))
        out.append(at)
    return [*out, len(scores)]


def decoded(scored: list[np.ndarray], tagger: Tagger) -> list[list[tuple[int, int, int, float]]]:
    """For each stretch the spans (kind, start, end, mean posterior) of the best tags over the whole of it."""
    parts = [(n, a, b) for n, s in enumerate(scored) for cuts in [_cuts(s)] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    parts.sort(key=lambda p: p[2] - p[1])
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in scored]
    at = 0
    while at < len(parts):
        size = at
        while size < len(parts) and (size - at + 1) * (parts[size][2] - parts[size][1]) <= max(CELLS, parts[at][2] - parts[at][1]):
            size += 1
        some = parts[at:size]
        at = size
        sizes = np.array([b - a for _, a, b in some])
        scores = np.zeros((int(sizes.max()), len(some), TAGS), np.float32)
        for i, (n, a, b) in enumerate(some):
            scores[: b - a, i] = scored[n][a:b]
        tags = _viterbi(scores, tagger.trans, sizes)
        hot = np.nonzero((tags > 0).any(1))[0]
        if not len(hot):
            continue
        _, p, _ = _marginals(scores[:, hot], tagger.trans, sizes[hot])
        for j, i in enumerate(hot):
            n, a, _ = some[i]
            sure = np.take_along_axis(p[:, j], tags[i][:, None].astype(np.int64), 1)[:, 0]
            out[n] += [(k, a + s, a + e, w) for k, s, e, w in _spans(tags[i], sure, sizes[i])]
    return out


def _spans(tags: np.ndarray, sure: np.ndarray, size: int) -> Iterator[tuple[int, int, int, float]]:
    t = 0
    while t < size:
        if tags[t] == 0:
            t += 1
            continue
        kind, a = (int(tags[t]) - 1) // 2, t
        t += 1
        while t < size and tags[t] == 2 + 2 * kind:
            t += 1
        yield kind, a, t, float(sure[a:t].mean())


def counted(kind: int, piece: str) -> bool:
    """Whether the digits of a span keep the numeric rule of its kind, which characters cannot show: parts at most 255, a card's check digit, a phone's length."""
    digits = re.sub("[^0-9]", "", piece)
    if kind == 1:
        parts = _DIGITS.findall(piece)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 4) and max(map(len, parts)) < 4
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != 3 or 8 <= len(digits) <= 15


def tag(texts: list[str], tagger: Tagger, confidence: float = CONFIDENCE) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the network finds, in order. A span that meets an end of its stretch makes the stretch twice as long on that side, until none does."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    work = [(n, a, b) for n, t in enumerate(texts) for a, b in regions(t)]
    while work:
        again: dict[int, list[tuple[int, int]]] = {}
        done: dict[int, list[tuple[int, int, list]]] = {}
        batch, size = [], 0
        while work and size < MOST:
            batch.append(work.pop())
            size += batch[-1][2] - batch[-1][1]
        spans = decoded(blended([codes(texts[n][a:b]) for n, a, b in batch], tagger), tagger)
        for (n, a, b), own in zip(batch, spans, strict=True):
            left, right = bool(own) and own[0][1] == 0 and a > 0, bool(own) and own[-1][2] == b - a and b < len(texts[n])
            if left or right:
                again.setdefault(n, []).append((max(0, a - (b - a) * left), min(len(texts[n]), b + (b - a) * right)))
            else:
                done.setdefault(n, []).append((a, b, own))
        for n, own in done.items():
            for a, _, spans_ in own:
                found[n] += [(k, a + s, a + e) for k, s, e, w in spans_ if w >= confidence]
        work += [(n, a, b) for n, own in again.items() for a, b in own]
    out = []
    for spans in found:  # a stretch that grew may have met a neighbour: the earlier, then longer span stays
        kept: list[tuple[int, int, int]] = []
        for k, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2], s[0])):
            if not kept or a >= kept[-1][2]:
                kept.append((k, a, b))
        out.append(kept)
    return out


def find(texts: list[str], tagger: Tagger, confidence: float = CONFIDENCE) -> list[tuple[list, list, list]]:
    """For each text its base spans, the spans that the network adds, which overlap no base span, and the secrets that it finds."""
    out = []
    for text, spans in zip(texts, tag(texts, tagger, confidence), strict=True):
        own = base_spans(text)
        ends = sorted((a, b) for _, a, b in own)
        free = [s for s in spans if counted(s[0], text[s[1] : s[2]]) and (s[0] == SECRET or EVIDENCE.search(text, s[1], s[2])) and not any(a < s[2] and s[1] < b for a, b in ends)]
        out.append((own, [s for s in free if s[0] < SECRET], [s for s in free if s[0] == SECRET]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _scan(tagger: Tagger, confidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = find([t.as_py() for t in part.column(1)], tagger, confidence)
                n_base = [pa.array([sum(k == s[0] for s in own) for own, _, _ in rows], pa.int64()) for k in range(SECRET)]
                digest = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _, _ in rows], pa.string())
                more = [pa.array(c, t) for c, t in (([joined(own + added) for own, added, _ in rows], pa.string()), ([len(added) for _, added, _ in rows], pa.int64()), ([len(s) for _, _, s in rows], pa.int64()), ([joined(s) for _, _, s in rows], pa.string()), ([len(a) + len(b) + len(c) for a, b, c in rows], pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *n_base, digest, *more], names=["id", *[f"n_{k}" for k in KINDS[:SECRET]], "base_sha256", "spans", "n_added", "n_secret", "secrets", "n_found"])

    return run


def scan(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """One row for each document: id, base spans by kind (``n_email`` ...), ``base_sha256``, all ``spans``, ``n_added`` (how many of them the network added), ``n_secret`` and ``secrets`` (passwords, tokens and keys, which the network alone finds), and ``n_found`` in all.

    Offsets are in code points, ends exclusive. A null text is empty; null and repeated ids stay as they are;
    very long texts are decoded a thousand windows at a time, and no span is lost at a window's end; one of over a quarter of LONGEST
    characters may come in parts. Only the two named columns are read; an empty table gives no rows.
    """
    long, string = T.LongType(), T.StringType()
    fields = [T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(f"n_{k}", long) for k in KINDS[:SECRET]], *[T.StructField(n, t) for n, t in (("base_sha256", string), ("spans", string), ("n_added", long), ("n_secret", long), ("secrets", string), ("n_found", long))]]
    out = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col)).mapInArrow(_scan(tagger or train(), confidence), T.StructType(fields))
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
