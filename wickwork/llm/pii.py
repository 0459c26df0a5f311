"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The base spans are the four patterns of ``KINDS`` with their checks. The model, trained in numpy from
labelled spans, tags characters (outside, begin or inside of a kind); it adds spans that the patterns miss and
never removes one.

The result is that of tagging every text in windows of ``WINDOW`` characters that overlap by half (a character's tag
scores are those of the window in which it lies deepest) and one Viterbi pass over the joined scores of the whole text,
wherever its spans lie. An added span counts if its probability under the CRF (forward and backward sums over ``REACH`` characters around it, for its
bounds and kind exactly) is at least ``SURE``, it does not touch a base span and it passes its kind's checks (``_plausible``): cards, phones and
addresses of machines the pattern's checks of digits, e-mails a sign for "at" before a dot, one of ``AT`` and ``DOT`` among them. As each of these needs a digit or a sign,
only such windows are computed first, and then their neighbours for as long as a
span might reach on: a text is cut only at characters that no best path tags as anything but outside (``_certain`` by each character's
own scores; where these do not tell, ``_carried`` by all scores at hand, so that the windows computed hardly depend on how sure a trained model is).

Learning: at most ``SAMPLE`` rows with base spans, chosen by a hash of the id (a documented, bounded sample), of each the parts
around up to ``PARTS`` spans and around up to ``PARTS`` other digits and signs, spread over the text; labelled with their base spans, and
``VARIANTS`` times more (up to ten times that where the sample is small) with the spans replaced by made-up ones in forms beyond the patterns (``disguised``, labelled) or by
numbers and words that only look alike (``decoy``, not labelled).

Defined results: null and empty texts have no spans; ids may be null or repeat; with nothing to learn from
no span is added; an empty table gives an empty result; other columns are not read. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import hash_sample, sliced

#: Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGITS = {"email": (0, 64), "ip": (4, 12), "card": (16, 19), "phone": (8, 15)}
SAMPLE, WINDOW, REACH, SURE = 400, 96, 40, 0.6
PARTS, VARIANTS, GROUP = 4, 3, 1 << 21  # spans and others of a row to learn from, made-up forms of each; characters tagged at a time
AT = r"(?:@|(?i:[(\[{<]at[)\]}>]))"  # e-mails have one of these
DOT = r"(?i:[(\[{<]dot[)\]}>]|(?<![^\W_])dot(?![^\W_]))"  # or this word
#: An added span has one of these: [0-9]+, AT or DOT, written so that a search passes quickly over other characters.
ANCHOR = re.compile(r"[0-9@(\[{<dD](?:(?<=[0-9])[0-9]*|(?<=@)|(?<=[(\[{<])(?:[aA][tT]|[dD][oO][tT])[)\]}>]|(?<=[dD])(?<![^\W_][dD])[oO][tT](?![^\W_]))")
AT_WORD = re.compile(r"(?i: at)\b")  # or, in e-mails with digits, this word
HIDDEN, EMBED, UPDATES, BATCH, RATE, CLASSES = 16, 12, 560, 96, 0.03, 56
MARGIN = 3.0  # in training: scores far apart leave few characters uncertain
MOST, PLAIN = 3600, 900  # windows to learn from, with and without labelled characters
CELLS = 1 << 16  # characters whose bounds are carried at a time
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fits(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in found.split("."))
    digits = "".join(c for c in found if "0" <= c <= "9")
    low, high = DIGITS[kind]
    return kind == "email" or low <= len(digits) <= high and (kind != "card" or luhn(digits))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind, then start."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            if "@" in text:
                out += [(k, a, b) for a, b in _emails(text)]
        elif kind != "phone" or "+" in text:
            out += [(k, m.start(), m.end()) for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text) if fits(kind, m.group())]
    return out


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The same matches as the pattern, which begin where a run of digits begins; linear in long runs.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ outwards: linear even in long runs without one."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > after and (text[start - 1] in _LOCAL_CHARS):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def codes(text: str) -> np.ndarray:
    """Character classes: zero and other digits, letters by case and those of "at" and "dot", signs each its own, beyond ASCII one."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _class[np.minimum(p, 128)]


_class = np.zeros(129, np.int64)
_class[48:58], _class[65:91], _class[97:123], _class[128] = 1, 2, 3, 4
for _k, _c in enumerate([*map(ord, "0atdoATDO"), *(c for c in range(32, 127) if not chr(c).isalnum())]):  # zero begins prefixes; the letters of "at" and "dot"
    _class[_c] = 5 + _k
assert _class.max() < CLASSES


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, LSTM in each direction, linear tag scores, CRF transitions."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"emb": r.normal(0, 0.3, (CLASSES, e)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.25, (e + h, 4 * h)), f"v{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        w, h = self.p[f"w{d}"], HIDDEN
        state, cell = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
        fed = x @ w[:EMBED].astype(x.dtype) + self.p[f"v{d}"].astype(x.dtype)
        back = w[EMBED:].astype(x.dtype)
        out, saved = np.zeros((n, t, h), x.dtype), []
        for s in range(t) if d == "f" else reversed(range(t)):
            z = fed[:, s] + state @ back
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, old = cell, state
            cell = f * cell + i * new
            tc = np.tanh(cell)
            state = o * tc
            out[:, s] = state
            if keep:
                saved.append((s, i, f, o, new, before, tc, old))
        return out, saved

    def scores(self, x: np.ndarray, keep: bool = False, dtype=np.float32):
        """Tag scores (n, t, TAGS) of rows of character classes."""
        e = self.p["emb"].astype(dtype)[x]
        (f, sf), (b, sb) = self._run(e, "f", keep), self._run(e, "b", keep)
        hidden = np.concatenate([f, b], 2)
        return hidden @ self.p["out"].astype(dtype) + self.p["bias"].astype(dtype), (e, hidden, sf, sb)

    def _crf(self, s: np.ndarray, y: np.ndarray):
        """Gradients of the mean negative log-likelihood by scores and transitions: forward and backward sums, scaled at each character."""
        n, t, k = s.shape
        least = lambda v: np.exp(np.maximum(v, -40))  # noqa: E731  # no sum underflows, which would leave no number in the model
        tr, own = least(self.p["trans"] - self.p["trans"].max()).astype(s.dtype), least(s - s.max(2, keepdims=True))
        a, b = np.empty_like(s), np.ones_like(s)
        a[:, 0] = own[:, 0] / own[:, 0].sum(1, keepdims=True)
        for i in range(1, t):
            x = (a[:, i - 1] @ tr) * own[:, i]
            a[:, i] = x / x.sum(1, keepdims=True)
        for i in reversed(range(t - 1)):
            x = (own[:, i + 1] * b[:, i + 1]) @ tr.T
            b[:, i] = x / x.sum(1, keepdims=True)
        g = a * b
        g /= g.sum(2, keepdims=True)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        g[rows, cols, y] -= 1
        later = own[:, 1:] * b[:, 1:]
        weight = 1 / ((a[:, :-1] @ tr) * later).sum(2, keepdims=True)
        pair = tr * np.tensordot(a[:, :-1] * weight, later, ((0, 1), (0, 1)))
        pair = pair - np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        return g / n, pair / n

    def gradients(self, x: np.ndarray, y: np.ndarray, dtype=np.float64, margin: float = 0.0) -> dict:
        """Of the softmax-margin loss: the true path must win by ``margin`` at each character that differs."""
        s, (e, hidden, sf, sb) = self.scores(x, True, dtype)
        s[np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :], y] -= dtype(margin)
        gs, gt = self._crf(s, y)
        g = {"trans": gt, "out": np.einsum("nth,ntk->hk", hidden, gs), "bias": gs.sum((0, 1))}
        gh = gs @ self.p["out"].astype(dtype).T
        ge, h = np.zeros_like(e), HIDDEN
        for d, saved, part in (("f", sf, gh[:, :, :h]), ("b", sb, gh[:, :, h:])):
            w = self.p[f"w{d}"].astype(dtype)
            gw, gv = np.zeros_like(w), np.zeros(4 * h, dtype)
            dh, dc = np.zeros((len(x), h), dtype), np.zeros((len(x), h), dtype)
            for step, i, f, o, new, before, tc, old in reversed(saved):
                dh = dh + part[:, step]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new**2)], 1)
                gw[:EMBED] += e[:, step].T @ dz
                gw[EMBED:] += old.T @ dz
                gv += dz.sum(0)
                ge[:, step] += dz @ w[:EMBED].T
                dh, dc = dz @ w[EMBED:].T, dc * f
            g |= {f"w{d}": gw, f"v{d}": gv}
        flat, ge = x.ravel(), ge.reshape(-1, EMBED)
        g["emb"] = np.stack([np.bincount(flat, c, CLASSES) for c in ge.T], 1)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int | None = None, seed: int = 2) -> Tagger:
        """Adam over shuffled batches."""
        r, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        epochs = epochs or -(-UPDATES // -(-len(x) // BATCH))
        total = epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows, t = order[a : a + BATCH], t + 1
                for k, g in self.gradients(x[rows], y[rows], np.float32, MARGIN).items():
                    g = np.clip(g, -5, 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - RATE * (1 - t / (total + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        best, links = s[0].astype(float), []
        for row in s[1:]:
            ways = best[:, None] + self.p["trans"]
            links.append(ways.argmax(0))
            best = ways.max(0) + row
        path = [int(best.argmax())]
        for link in reversed(links):
            path.append(int(link[path[-1]]))
        return np.array(path[::-1])

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans of the model that touch no base span, per text."""
        out: list[list[tuple[int, int, int]]] = []
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= GROUP:
                size += len(texts[to])
                to += 1
            out += self._added(texts[at:to], base[at:to])
            at = to
        return out

    def _added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        code: dict[int, np.ndarray] = {}
        known: dict[tuple[int, int], np.ndarray] = {}  # tag scores by text and window
        todo = []  # text, first and last anchor, first and last window, windows to add at a time
        for i, t in enumerate(texts):
            for m in ANCHOR.finditer(t):
                if i not in code:
                    code[i] = codes(t)
                a, b = _owner(m.start(), len(t)), _owner(m.end() - 1, len(t))
                if todo and todo[-1][0] == i and todo[-1][4] + 1 >= a:
                    todo[-1][2], todo[-1][4] = m.end() - 1, b
                else:
                    todo.append([i, m.start(), m.end() - 1, a, b, 1])
        while todo:
            self._score(code, known, sorted({(i, w) for i, _, _, a, b, _ in todo for w in range(a, b + 1)} - known.keys()))
            more, doubtful = [], []
            for job in todo:
                i, p, q, a, b, _ = job
                start, last = _owned(a, len(texts[i]))[0], _owner(len(texts[i]) - 1, len(texts[i]))
                s = np.concatenate([known[i, w] for w in range(a, b + 1)])
                sure = self._certain(s)
                sides = []  # parts around the first and the last anchor, where no character of the side is certain
                if a > 0 and not sure[: p - start + 1].any():
                    sides.append((0, s[: p - start + 1 + REACH], False, b == last and p - start + 1 + REACH >= len(s)))
                if b < last and not sure[q - start :].any():
                    sides.append((max(0, q - start - REACH), s[max(0, q - start - REACH) :], a == 0 and q - start <= REACH, False))
                doubtful.append((job, start, last, s, sure, sides))
            carried = iter(self._carried([side[1:] for *_, sides in doubtful for side in sides]))
            for (i, p, q, a, b, step), start, last, s, sure, sides in doubtful:
                for x, part, *_ in sides:
                    sure[x : x + len(part)] |= next(carried)
                before, after = np.flatnonzero(sure[: p - start + 1]), np.flatnonzero(sure[q - start :])
                left, right = a > 0 and not len(before), b < last and not len(after)
                if left or right:
                    more.append([i, p, q, max(0, a - step) if left else a, min(last, b + step) if right else b, 2 * step])
                else:
                    x, y = before[-1] if len(before) else 0, q - start + after[0] + 1 if len(after) else len(s)
                    out[i] += self._spans(texts[i], base[i], s[x:y], start + x, sure[x:y])
            todo = more
        # the spans that are probable enough, by the scores around them
        around = {(i, *f): (max(0, f[1] - REACH), min(len(texts[i]), f[2] + REACH)) for i, o in enumerate(out) for f in o}
        spans = {f: (_owner(x, len(texts[f[0]])), _owner(y - 1, len(texts[f[0]]))) for f, (x, y) in around.items()}
        self._score(code, known, sorted({(f[0], w) for f, (a, b) in spans.items() for w in range(a, b + 1)} - known.keys()))
        out = [[] for _ in texts]
        for f, (x, y) in around.items():
            i, kind, a, b = f
            start = _owned(spans[f][0], len(texts[i]))[0]
            s = np.concatenate([known[i, w] for w in range(spans[f][0], spans[f][1] + 1)])[x - start : y - start]
            if self.chance(s, a - x, b - x, kind) >= SURE:
                out[i].append((kind, a, b))
        return [sorted(o) for o in out]

    def _score(self, code: dict[int, np.ndarray], known: dict[tuple[int, int], np.ndarray], windows: list[tuple[int, int]]) -> None:
        """Adds the tag scores of each window's own characters to ``known``."""
        for at in range(0, len(windows), 1024):
            part = windows[at : at + 1024]
            rows = np.zeros((len(part), WINDOW), np.int64)
            for row, (i, w) in zip(rows, part, strict=True):
                c = code[i][w * STEP : w * STEP + WINDOW]
                row[: len(c)] = c
            for (i, w), s in zip(part, self.scores(rows)[0], strict=True):
                a, b = _owned(w, len(code[i]))
                known[i, w] = s[a - w * STEP : b - w * STEP].copy()

    def _certain(self, s: np.ndarray) -> np.ndarray:
        """True where every best path is outside: no transition can make up for the scores, whatever the neighbours or because one of them is outside."""
        t = self.p["trans"]
        enter, leave = np.maximum(0, (t - t[:, :1]).max(0)), np.maximum(0, (t - t[:1]).max(1))
        above = lambda gain: (s[:, :1] - s[:, 1:] > gain[1:] + 1e-3).all(1)
        sure = above(enter + leave)
        sure = _spread(sure, above(t[0] - t[0, 0] + leave))
        return _spread(sure[::-1], above(enter + t[:, 0] - t[0, 0])[::-1])[::-1]

    def _carried(self, parts: list[tuple[np.ndarray, bool, bool]]) -> list[np.ndarray]:
        """As ``_certain``, of parts of texts (scores, whether the text begins, whether it ends there), by bounds carried over the characters from both ends."""
        out, order = [np.zeros(0, bool)] * len(parts), sorted(range(len(parts)), key=lambda k: len(parts[k][0]))
        while order:
            some = order[-max(1, CELLS // max(1, len(parts[order[-1]][0]))) :]
            del order[-len(some) :]
            ahead = self._leads([parts[k][0] for k in some], [parts[k][1] for k in some], self.p["trans"])
            back = self._leads([parts[k][0][::-1] for k in some], [parts[k][2] for k in some], self.p["trans"].T)
            for row, k in enumerate(some):
                s = parts[k][0]
                lead = ahead[: len(s), 1:, row] + back[: len(s), 1:, row][::-1] - (s[:, :1] - s[:, 1:])  # both have the character's own scores
                out[k] = (lead > 1e-3).all(1)
        return out

    @staticmethod
    def _leads(parts: list[np.ndarray], begins: list[bool], t: np.ndarray) -> np.ndarray:
        """By character, tag and part: by how much at least the best path that is outside there beats the best one with that tag, whatever lies before the part."""
        ahead = np.zeros((max(map(len, parts)), TAGS, len(parts)))
        for row, s in enumerate(parts):
            ahead[: len(s), :, row] = s[:, :1] - s
        first, lead = ahead[0].copy(), np.full((TAGS, len(parts)), -np.inf)
        for i in range(len(ahead)):  # a path that comes to the tag from j does so to outside too, or from outside, which leads j
            lead = ahead[i] + (np.maximum(t[:, :1], t[0, 0] + lead)[:, None] - t[:, :, None]).min(0)
            if not i:
                lead = np.where(begins, first, lead)
            ahead[i] = lead
        return ahead

    def _spans(self, text: str, base: list[tuple[int, int, int]], s: np.ndarray, start: int, sure: np.ndarray) -> list[tuple[int, int, int]]:
        """Spans in the part of the text that begins at ``start`` and has the scores ``s``, cut where ``sure``."""
        out, ends = [], np.unique(np.r_[0, np.flatnonzero(sure), len(s) - 1])
        some = (np.diff(ends) > 1) | ~sure[ends[:-1]] | ~sure[ends[1:]]
        for x, y in zip(ends[:-1][some].tolist(), ends[1:][some].tolist(), strict=True):
            found = ANCHOR.findall(text, start + x, start + y + 1)
            if all(f.isdigit() for f in found) and sum(map(len, found)) < 4 and not AT_WORD.search(text, start + x, start + y + 1):  # only e-mails have fewer digits
                continue
            part = s[x : y + 1].astype(float)
            part[[k for k in (0, -1) if sure[(x, y)[k]]], 1:] = -np.inf
            tags = self.viterbi(part)
            if not tags.any():
                continue
            k = 0
            while k < len(tags):
                end = k + 1
                if tags[k] and tags[k] % 2:
                    kind = (tags[k] - 1) // 2
                    while end < len(tags) and tags[end] == tags[k] + 1:
                        end += 1
                    a, b = start + x + k, start + x + end
                    if self._plausible(text, kind, a, b) and all(b <= u or a >= v for _, u, v in base):
                        out.append((int(kind), a, b))
                k = end
        return out

    def chance(self, s: np.ndarray, k: int, end: int, kind: int) -> float:
        """The CRF's probability, in a part of a text with scores ``s``, that a span of ``kind`` begins at ``k`` and ends before ``end``."""
        s, tr, tag = s.astype(float), self.p["trans"], 2 * kind + 1
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[0] = s[0]
        for i in range(1, len(s)):
            a[i] = s[i] + lse(a[i - 1][:, None] + tr, 0)
        for i in reversed(range(len(s) - 1)):
            b[i] = lse(tr + (s[i + 1] + b[i + 1])[None, :], 1)
        path = [tag] + [tag + 1] * (end - k - 1)
        total = a[k, tag] + sum(tr[u, v] for u, v in zip(path, path[1:], strict=False)) + s[k + 1 : end, tag + 1].sum() - lse(a[-1], 0)
        if end == len(s):
            return float(np.exp(total))
        return float(np.exp(total + lse(np.delete(tr[path[-1]] + s[end] + b[end], tag + 1), 0)))

    @staticmethod
    def _plausible(text: str, kind: int, start: int, end: int) -> bool:
        """Whole runs of letters and digits at both ends, and the kind's checks of digits, as for base spans; e-mails have signs for "at" and dot."""
        found, name = text[start:end], KINDS[kind]
        whole = not (start and text[start - 1].isalnum() and found[0].isalnum()) and not (end < len(text) and text[end].isalnum() and found[-1].isalnum())
        if not whole or any(c.isspace() and c != " " for c in found):
            return False
        if name == "email":
            return bool(re.search(rf"\w(?: ?{AT}| (?i:at)\b)(?=.*\w *(?:\.|{DOT}) *\w) ?\w", found)) and bool(ANCHOR.search(found)) and any(c.isalpha() for c in found)
        if any(c.isalpha() for c in re.sub(DOT, "", found)):
            return False
        runs = re.findall("[0-9]+", found)
        return len(runs) == 4 and fits(name, ".".join(runs)) if name == "ip" else fits(name, found)


STEP = WINDOW // 2


def _spread(seed: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """True at ``seed`` and where only ``ok`` lies between it and the last ``seed`` before."""
    at = np.arange(len(seed))
    return np.maximum.accumulate(np.where(seed, at, -1)) > np.maximum.accumulate(np.where(seed | ok, -1, at))


def _owner(at: int, size: int) -> int:
    """The window, of those that begin every ``STEP`` characters, in which a character of a text of ``size`` lies deepest."""
    return min(max(0, at - STEP // 2) // STEP, max(0, -(-size // STEP) - 2))


def _owned(window: int, size: int) -> tuple[int, int]:
    """The characters that lie deepest in a window."""
    first = window * STEP + STEP // 2 if window else 0
    return first, size if window == _owner(size - 1, size) else window * STEP + STEP // 2 + STEP


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text within REACH of a digit or a sign of e-mails."""
    start = end = -1
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if a <= end:
            end = b
        else:
            if end > 0:
                yield start, end
            start, end = a, b
    if end > 0:
        yield start, end


def _word(rng: random.Random, low: int = 2, high: int = 9) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def disguised(kind: str, rng: random.Random) -> str:
    """A made-up value of a kind in a form that the patterns miss, or (some) match in part or whole."""
    if kind == "email":
        name = rng.choice(["", _word(rng, 1) + rng.choice("._-")]) + rng.choice([_word(rng), _word(rng) + _digits(rng, rng.randint(1, 3)), _digits(rng, 2), _word(rng, 1, 3)])
        at = rng.choice(["(at)", "[at]", "{at}", "<at>", " @ ", " (at) ", " [at] ", "(AT)", "[AT]", " at "])
        dot = rng.choice([" dot ", "(dot)", "[dot]", " (dot) ", " [dot] "]) if at == " at " else rng.choice([".", ".", ".", " dot ", "(dot)", "[dot]", " (dot) "])
        return name + at + dot.join([_word(rng) + rng.choice(["", _digits(rng, 1)]) for _ in range(rng.choice([1, 1, 2]))] + [rng.choice(["com", "org", "net", "de", "fr", "es", "info", "io"])])
    if kind == "ip":
        sep = rng.choice([",", " . ", "[.]", "(.)", "(dot)", "[dot]", " dot ", ". ", " ,", ", "])
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n = rng.choice([16, 16, 16, 17, 18, 19])
        body = rng.choice("3456") + _digits(rng, n - 2)
        body += next(d for d in "0123456789" if luhn(body + d))
        step = rng.choice([4, 4, 4, 4, 5, 8])
        return rng.choice([".", "/", "  ", "_", " - ", "--", " . ", ",", ":", " / ", "\u2013"]).join(body[i : i + step] for i in range(0, n, step))
    sep = rng.choice(["/", ".", " / ", "_", " - ", ",", " . ", "\u2013", "  ", ":"])
    head = rng.choice(["+", "+", "+ ", "00", "(+", "(00"])
    code = str(rng.randint(1, 99)).zfill(rng.choice([1, 2]))
    groups = [_digits(rng, rng.randint(2, 4)) for _ in range(rng.randint(2, 4))]
    while sum(map(len, groups)) + len(code) + 2 * head.endswith("00") > 15 or sum(map(len, groups)) < 6:
        groups = [_digits(rng, rng.randint(2, 4)) for _ in range(rng.randint(2, 3))]
    return head + code + (")" if "(" in head else "") + rng.choice([sep, " ", ""] if "(" in head else [sep]) + sep.join(groups)


def decoy(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    n, d = rng.randint, lambda k: _digits(rng, k)
    return rng.choice([
        f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2099)}", f"{n(1, 28)}/{n(1, 12)}/{n(1900, 2099)}", f"{n(0, 23)}:{n(0, 59):02}:{n(0, 59):02}", f"{n(0, 99)}.{d(2)}", f"{n(1, 999)},{d(3)},{d(3)}",
        d(n(1, 8)), f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"$ {n(1, 999)},{d(3)}.{d(2)}", f"{d(2)}%", f"@ {_word(rng)}", f"@{_word(rng)}", f"{_word(rng)} at {_word(rng)}", f"{_word(rng)} dot {_word(rng)}", f"{n(1, 9)}. {n(1, 9)}. {n(1, 9)}.", f"v{n(0, 9)}.{n(0, 99)}",
        f"{d(4)} {d(4)}", f"{n(1, 99)} + {n(1, 99)} = {n(1, 99)}", f"{n(1, 99)} / {n(1, 99)}", f"[{n(1, 99)}]", f"({n(1, 99)})", f"{d(2)}, {d(2)}, {d(2)}", f"{n(1900, 2099)}/{d(2)}", f"#{d(6)}", f"{d(5)}-{d(4)}", f"{_word(rng)}_{d(3)}", f"{_word(rng)}.{_word(rng)}", "dot", "at",
    ])


def _varied(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans replaced by disguised ones of any kind, in places by decoys."""
    out, moved, at = "", [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        out += text[at:a]
        if rng.random() < 0.3:
            out += decoy(rng)
        else:
            k = rng.choice([0, 0, 0, 1, 2, 3])  # e-mails have the most forms
            found = disguised(KINDS[k], rng)
            moved.append((k, len(out), len(out) + len(found)))
            out += found
        at = b
    return out + text[at:], moved


def parts(text: str) -> list[str]:
    """Parts of a text around base spans and other digits and signs, each followed by its base spans; none without base spans."""
    spans = sorted(base_spans(text), key=lambda s: s[1])
    if not spans:
        return []
    others = [(0, a, b) for a, b in stretches(text) if all(b <= x or a >= y for _, x, y in spans)]
    some = [g[k * len(g) // PARTS] for g in (spans, others) if g for k in range(PARTS)]
    cuts = sorted({(max(0, a - WINDOW), min(len(text), min(b, a + 4 * WINDOW) + WINDOW)) for _, a, b in some})
    out: list[str] = []
    for a, b in cuts:
        inside = [(k, max(x, a) - a, min(y, b) - a) for k, x, y in spans if x < b and y > a]
        out += [text[a:b], ",".join(f"{k}:{x}:{y}" for k, x, y in inside)]
    return out


def _gap(text: str, rng: random.Random) -> list[tuple[int, int, int]]:
    """A place between two words."""
    gaps = [m.start() + 1 for m in re.finditer(r"(?= \w)", text)] or [len(text)]
    at = rng.choice(gaps)
    return [(0, at, at)]


def examples(found: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags, of labelled parts of texts."""
    rng, xs, ys = random.Random(seed), [], []
    variants = max(VARIANTS, min(10 * VARIANTS, MOST // max(1, sum(len(s) or 1 for _, s in found))))
    for t, spans in found:
        for text, labelled in ((t, spans), *(_varied(t, spans or _gap(t, rng), rng) for _ in range(variants))):
            tags = np.zeros(len(text), np.int64)
            for k, a, b in labelled:
                tags[a:b] = 2 + 2 * k
                tags[a] = 1 + 2 * k
            c = codes(text)
            for w in range(0, max(1, len(text) - STEP), STEP):
                row, tag = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                n = min(WINDOW, len(text) - w)
                row[:n], tag[:n] = c[w : w + n], tags[w : w + n]
                xs.append(row)
                ys.append(tag)
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled parts of at most ``SAMPLE`` rows with base spans."""
    cut = F.pandas_udf(lambda t: t.map(lambda x: parts(x or "")), "array<string>")
    rows = docs.select(F.xxhash64(id_col).alias("h"), cut(F.col(text_col)).alias("t"))
    got = [r["t"] for r in hash_sample(rows, SAMPLE, "h", docs.count(), F.size("t") > 0)]
    read = lambda s: [tuple(map(int, x.split(":"))) for x in s.split(",")] if s else []
    return [(t, read(s)) for r in got for t, s in zip(r[::2], r[1::2], strict=True)]


def chosen(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Windows to learn from, in a fixed random order: up to MOST with labelled characters, up to PLAIN others."""
    order = np.random.default_rng(0).permutation(len(x))
    some = y[order].any(1)
    return np.sort(np.r_[order[some][:MOST], order[~some][:PLAIN]])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """Fits on the bounded sample; ``None`` without labelled spans."""
    x, y = examples(sample(docs, id_col, text_col))
    keep = chosen(x, y)
    return Tagger().fit(x[keep], y[keep]) if y.any() else None


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None, learn: bool = True) -> DataFrame:
    """Per row: id, counts of the base spans, ``base_sha256`` and all ``spans``."""
    tagger = model or (train(docs, id_col, text_col) if learn else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = tagger.added(texts, base) if tagger else [[] for _ in texts]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([digest(sorted(b + m)) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, spans], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string").withColumnRenamed("id", id_col)
