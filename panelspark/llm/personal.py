"""Operator 4: personal data by a character-level bidirectional LSTM with a CRF, and base rules.

The base rules find e-mail and IP addresses, card and phone numbers exactly; their spans always
stay. The network is trained in numpy on labelled windows: a bounded sample (`WINDOWS`, drawn by
hash) of windows around digits and at-signs, labelled by the base rules, and `INVENTED` windows made from it:
values of a labelled span's kind and shape with other digits and names, in a form that the rules miss (dotted card
numbers, phone numbers without plus, bracketed at-signs and dots), at any place of another window's text,
at times cut by its ends.

A text is cut into windows of `WIDTH` characters that overlap by half. Only windows with a digit,
an at-sign or a bracketed "at" are read: every span must hold one of these, so the others have
none. Each is decoded with the CRF. Overlapping windows are stitched to one line of tags, each position from
the window in which it lies most central, so spans may cross borders and be longer than a window.
Over the whole text, candidates that pass their kind's test (digits, Luhn, parts under 256) and a
confidence calibrated per kind on held-back windows compete: the surest first, none may overlap a base span
or another. So the network adds to the rules, never takes away.

Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows get
equal answers; ties between candidates go to the earlier, then to the longer one. Without any
labelled span in the table nothing is added. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WIDTH = 96
STRIDE = WIDTH // 2
WINDOWS = 3_000
INVENTED = 4_000
HIDDEN, DIM = 20, 12
EPOCHS = 8
PRECISION = 0.99
BLOCK, MOST = 1_024, 960
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where its digits begin, and digits are not given back: linear on long runs of them
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def fits(kind: int, text: str) -> bool:
    """Whether a matched text passes its kind's test."""
    if kind == 0:
        return True
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base rules, by kind and start."""
    if not text:
        return []
    out: list[Span] = []
    # each address holds the first at-sign after its start; going left from it keeps this linear
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((0, start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for kind, rule in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text) if fits(kind, m[0])]
    return out


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---- the network ----------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """One code per character: ASCII as it is, letters and the rest beyond it in two classes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int64)


PAD, SYMBOLS = 130, 131


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """States (time, batch, hidden) for inputs (time, batch, 4 * hidden), and what backward needs."""
    steps, batch, h = x.shape[0], x.shape[1], wh.shape[0]
    out, kept = np.zeros((steps, batch, h), x.dtype), []
    hid, cell = np.zeros((batch, h), x.dtype), np.zeros((batch, h), x.dtype)
    for t in range(steps):
        z = x[t] + hid @ wh
        gates = _sigmoid(z[:, : 3 * h])
        new = np.tanh(z[:, 3 * h :])
        before = cell
        cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
        squashed = np.tanh(cell)
        kept.append((gates, new, before, squashed, hid))
        hid = gates[:, 2 * h :] * squashed
        out[t] = hid
    return out, kept


def _lstm_back(grad: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent weights."""
    h = wh.shape[0]
    dx, dwh = np.zeros((*grad.shape[:2], 4 * h), grad.dtype), np.zeros_like(wh)
    dh, dc = np.zeros(grad.shape[1:], grad.dtype), np.zeros(grad.shape[1:], grad.dtype)
    for t in range(len(kept) - 1, -1, -1):
        gates, new, before, squashed, hid = kept[t]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.hstack([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)])
        dx[t], dc = dz, dc * f
        dwh += hid.T @ dz
        dh = dz @ wh.T
    return dx, dwh


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Weights; windows are padded on the right to WIDTH, pads are outside."""

    w: dict[str, np.ndarray]
    thresholds: list[float] = field(default_factory=lambda: [1.1] * len(KINDS))

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (time, batch, tags) of codes (batch, time)."""
        w, x = self.w, self.w["table"][ids.T]
        ahead, kept_a = _lstm(x @ w["xa"] + w["ba"], w["ha"])
        back, kept_b = _lstm(x[::-1] @ w["xb"] + w["bb"], w["hb"])
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ w["out"] + w["bo"], (x, kept_a, kept_b, both)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log of: the sum over all paths, forward, backward, and tag probabilities."""
        t_n, b_n, k = scores.shape
        trans = self.w["trans"]
        fore, aft = np.zeros_like(scores), np.zeros_like(scores)
        fore[0] = scores[0]
        for t in range(1, t_n):
            fore[t] = _lse(fore[t - 1][:, :, None] + trans[None], 1) + scores[t]
        for t in range(t_n - 2, -1, -1):
            aft[t] = _lse(trans[None] + (scores[t + 1] + aft[t + 1])[:, None, :], 2)
        total = _lse(fore[-1], 1)
        return total, fore, aft, fore + aft - total[None, :, None]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (batch, time), and the probability of each tag taken."""
        scores, _ = self.forward(ids)
        t_n, b_n, k = scores.shape
        trans, best = self.w["trans"], scores[0]
        came = np.zeros((t_n, b_n, k), np.int8)
        for t in range(1, t_n):
            options = best[:, :, None] + trans[None]
            came[t] = options.argmax(1)
            best = options.max(1) + scores[t]
        tags = np.zeros((t_n, b_n), np.int64)
        tags[-1] = best.argmax(1)
        for t in range(t_n - 1, 0, -1):
            tags[t - 1] = came[t][np.arange(b_n), tags[t]]
        logp = self.marginals(scores)[3]
        return tags.T, np.exp(np.take_along_axis(logp, tags[:, :, None], 2)[:, :, 0]).T

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        w = self.w
        scores, (x, kept_a, kept_b, both) = self.forward(ids)
        t_n, b_n, k = scores.shape
        y, trans = tags.T, w["trans"]
        total, fore, aft, logp = self.marginals(scores)
        path = np.take_along_axis(scores, y[:, :, None], 2).sum() + trans[y[:-1], y[1:]].sum()
        loss = float((total.sum() - path) / b_n)
        dscores = np.exp(logp)
        np.put_along_axis(dscores, y[:, :, None], np.take_along_axis(dscores, y[:, :, None], 2) - 1, 2)
        dscores /= b_n
        pair = np.exp(fore[:-1][:, :, :, None] + trans + (scores[1:] + aft[1:])[:, :, None, :] - total[None, :, None, None])
        dtrans = pair.sum((0, 1))
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
        g = {"trans": dtrans / b_n, "out": np.einsum("tbh,tbk->hk", both, dscores), "bo": dscores.sum((0, 1))}
        dboth = dscores @ w["out"].T
        h = HIDDEN
        da, g["ha"] = _lstm_back(dboth[:, :, :h], kept_a, w["ha"])
        db, g["hb"] = _lstm_back(dboth[::-1, :, h:], kept_b, w["hb"])
        g["xa"], g["ba"] = np.einsum("tbd,tbz->dz", x, da), da.sum((0, 1))
        g["xb"], g["bb"] = np.einsum("tbd,tbz->dz", x[::-1], db), db.sum((0, 1))
        dx = da @ w["xa"].T + (db @ w["xb"].T)[::-1]
        g["table"] = np.zeros_like(w["table"])
        np.add.at(g["table"], ids.T.ravel(), dx.reshape(-1, DIM))
        return loss, g


def new_tagger(seed: int = 3) -> Tagger:
    rng = np.random.default_rng(seed)

    def some(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    w = {"table": some(SYMBOLS, DIM) * np.float32(3), "xa": some(DIM, 4 * HIDDEN), "xb": some(DIM, 4 * HIDDEN)}
    w |= {"ha": some(HIDDEN, 4 * HIDDEN), "hb": some(HIDDEN, 4 * HIDDEN), "out": some(2 * HIDDEN, TAGS)}
    w |= {x: np.zeros(4 * HIDDEN, np.float32) for x in ("ba", "bb")} | {"bo": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    w["ba"][HIDDEN : 2 * HIDDEN] = w["bb"][HIDDEN : 2 * HIDDEN] = 1
    return Tagger(w)


def _padded(texts: list[str]) -> np.ndarray:
    out = np.full((len(texts), WIDTH), PAD, np.int64)
    for i, text in enumerate(texts):
        own = codes(text)[:WIDTH]
        out[i, : len(own)] = own
    return out


def _tags(spans: list[Span]) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    for kind, a, b in spans:
        out[max(a, 0) : min(b, WIDTH)] = 2 + 2 * kind
        if 0 <= a < WIDTH:
            out[a] = 1 + 2 * kind
    return out


def tagged_spans(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    t = 0
    while t < len(tags):
        if tags[t] and tags[t] % 2:
            kind, end = (int(tags[t]) - 1) // 2, t + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            out.append((kind, t, end))
            t = end
        else:
            t += 1
    return out


def rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The window with each span in a form that the base rules miss."""
    parts, out, at = [], [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        own = text[a:b]
        if kind == 0:
            mark, dot = [("(at)", "."), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)")][rng.integers(4)]
            own = own.replace("@", mark)
            own = own[: own.index(mark)] + own[own.index(mark) :].replace(".", dot)
        elif kind == 1:
            own = own.replace(".", ["[.]", " . ", "(.)"][rng.integers(3)])
        elif kind == 2:
            digits, sep = _digits(own), [".", "/", "_"][rng.integers(3)]
            own = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            digits = _digits(own)[-10:]
            own = [f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"00{_digits(own)}"][rng.integers(3)]
        parts += [text[at:a], own]
        start = sum(map(len, parts)) - len(own)
        out.append((kind, start, start + len(own)))
        at = b
    parts.append(text[at:])
    return "".join(parts), out


def fresh(kind: int, own: str, words: list[str], rng: np.random.Generator) -> str:
    """Another value of the same kind and shape: new digits that pass the kind's test, another name and host."""
    if kind == 0:
        name, host = own.split("@", 1)
        tail = host.split(".")[-1]
        parts = [words[rng.integers(len(words))] for _ in range(rng.integers(2, 4))]
        name = ["", ".", "_", "-"][rng.integers(4)].join(parts[:-1]) + ("" if rng.random() < 0.5 else str(rng.integers(1, 1000)))
        more = [parts[-1], *(words[rng.integers(len(words))] for _ in range(rng.integers(0, 2)))]
        return f"{name}@{'.'.join(more)}.{tail if rng.random() < 0.5 else words[rng.integers(len(words))][:3]}"
    if kind == 1:
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))
    digits = [str(d) for d in rng.integers(0, 10, len(_digits(own)))]
    if kind == 2:
        digits[-1] = next(d for d in "0123456789" if luhn("".join(digits[:-1]) + d))
    given = iter(digits)
    return "".join(next(given) if c.isascii() and c.isdigit() else c for c in own)


def invented(kind: int, own: str, filler: str, words: list[str], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A window of foreign text around a fresh value, hidden from the base rules, anywhere in it and at times cut by its ends."""
    value = fresh(kind, own, words, rng)
    hidden, _ = rewritten(value, [(kind, 0, len(value))], rng)
    gaps = [i for i, c in enumerate(filler) if c == " "] or [0]
    cut = gaps[rng.integers(len(gaps))]
    glue = ["", " ", ": ", " (", ", ", "\n"][rng.integers(1, 6)]
    text = filler[:cut] + glue + hidden + ["", ".", ",", ")", ""][rng.integers(5)] + " " + filler[cut:].lstrip()
    start = cut + len(glue)
    # a window is WIDTH long: it may begin inside the value or end there
    shift = int(rng.integers(max(0, start + len(hidden) // 2 - WIDTH), start + 1)) if rng.random() < 0.5 else max(0, start + len(hidden) - WIDTH)
    return text[shift : shift + WIDTH], [(kind, start - shift, start + len(hidden) - shift)]


def examples_of(windows: list[str], rng: np.random.Generator, size: int = INVENTED) -> list[tuple[str, list[Span]]]:
    """Windows with their base spans, and ``size`` invented ones, as many of each kind that has a labelled span."""
    out: list[tuple[str, list[Span]]] = []
    by_kind: dict[int, list[str]] = {}
    fillers = []
    for text in windows:
        spans = base_spans(text)
        # of overlapping spans the network learns the earlier
        apart: list[Span] = []
        for s in sorted(spans, key=lambda s: (s[1], -s[2])):
            if not apart or s[1] >= apart[-1][2]:
                apart.append(s)
        out.append((text, apart))
        for kind, a, b in apart:
            by_kind.setdefault(kind, []).append(text[a:b])
        if not spans:
            fillers.append(text)
    fillers = fillers or [re.sub(r"[^\s]*[0-9@][^\s]*", "", t) for t in windows]
    words = sorted({w.lower() for t in fillers for w in re.findall(r"[A-Za-z]{2,12}", t)}) or ["name", "host", "mail"]
    for k in range(size if by_kind else 0):
        kind = sorted(by_kind)[k % len(by_kind)]
        values = by_kind[kind]
        out.append(invented(kind, values[rng.integers(len(values))], fillers[rng.integers(len(fillers))], words, rng))
    return out


def fit(windows: list[str], epochs: int = EPOCHS, seed: int = 3) -> Tagger:
    """Train on windows labelled by the base rules and on invented ones; thresholds from a sixth held back."""
    rng = np.random.default_rng(seed)
    examples = examples_of(windows, rng)
    tagger = new_tagger(seed)
    if not any(spans for _, spans in examples):
        return tagger
    order = rng.permutation(len(examples))
    ids = _padded([examples[i][0] for i in order])
    tags = np.stack([_tags(examples[i][1]) for i in order])
    held = np.arange(len(order)) % 6 == 5
    first, second = {k: np.zeros_like(v) for k, v in tagger.w.items()}, {k: np.zeros_like(v) for k, v in tagger.w.items()}
    step, train = 0, np.flatnonzero(~held)
    for epoch in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            some = train[at : at + 64]
            _, grads = tagger.gradients(ids[some], tags[some])
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
            step += 1
            rate = 0.02 * (1 - epoch / (epochs + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                tagger.w[k] = (tagger.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    # per kind, the confidence from which on held-back spans are right: what the operator would accept counts
    seen: dict[int, list[tuple[float, bool]]] = {}
    check = np.flatnonzero(held)
    for at in range(0, len(check), 256):
        some = check[at : at + 256]
        found, sure = tagger.decode(ids[some])
        for i, row, line in zip(some, found, sure, strict=True):
            text, spans = examples[order[i]]
            right = {(k, max(a, 0), min(b, WIDTH)) for k, a, b in spans}
            for k, a, b in tagged_spans(row):
                b = min(b, len(text))
                if (k, a, b) in right or acceptable(k, text, a, b):
                    seen.setdefault(k, []).append((float(line[a:b].min()), (k, a, b) in right))
    for kind, rows in seen.items():
        good = 0
        for n, (sure, ok) in enumerate(sorted(rows, reverse=True), 1):
            good += ok
            if good / n >= PRECISION:
                tagger.thresholds[kind] = max(sure, 0.5)
    return tagger


def acceptable(kind: int, text: str, a: int, b: int) -> bool:
    """Whether a candidate passes the tests of its kind and stands alone in its text."""
    own = text[a:b]
    if not own or own != own.strip() or not ANCHOR.search(own) or not fits(kind, own):
        return False
    if kind == 0:
        return bool(re.search(r"[^\s@(\[][ ]?(?:@|[(\[] ?at ?[)\]]) ?[A-Za-z0-9].*[A-Za-z0-9]", own))
    # a number is whole: no digit before or after it
    return not (text[a - 1 : a].isalnum() if a else False) and not text[b : b + 1].isalnum()


# ---- texts ----------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold an anchor."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    out: list[int] = []
    for m in ANCHOR.finditer(text):
        a = m.start()
        for n in range(max(0, (a - WIDTH) // STRIDE + 1), min(last, a // STRIDE) + 1):
            if not out or n * STRIDE > out[-1]:
                out.append(n * STRIDE)
    return out


def stitched(starts: list[int], tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, tags, confidence) of each run of overlapping windows of one text.

    A position is taken from the window in which it lies most central, so a span may cross any
    number of window borders.
    """
    edge, at = (WIDTH - STRIDE) // 2, 0
    while at < len(starts):
        end = at + 1
        while end < len(starts) and starts[end] - starts[end - 1] == STRIDE:
            end += 1
        cuts = [(0 if k == at else edge, WIDTH if k == end - 1 else edge + STRIDE) for k in range(at, end)]
        yield (
            starts[at],
            np.concatenate([tags[k][a:b] for k, (a, b) in zip(range(at, end), cuts)]),
            np.concatenate([sure[k][a:b] for k, (a, b) in zip(range(at, end), cuts)]),
        )
        at = end


def added_spans(texts: list[str | None], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """What the network adds to the base spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    if min(tagger.thresholds) > 1:
        return out
    places = [(i, start) for i, text in enumerate(texts) if text for start in window_starts(text)]
    candidates: list[dict[Span, float]] = [{} for _ in texts]
    for at in range(0, len(places), BLOCK):
        # windows of all texts share batches; blocks overlap by MOST characters, so no span is lost at their borders
        low, high = max(0, at - MOST // STRIDE), min(len(places), at + BLOCK)
        some = places[low:high]
        decoded = [tagger.decode(_padded([texts[i][s : s + WIDTH] for i, s in some[k : k + 256]])) for k in range(0, len(some), 256)]
        found, sure = (np.concatenate(x) for x in zip(*decoded))
        k = 0
        while k < len(some):
            i, end = some[k][0], k
            while end < len(some) and some[end][0] == i:
                end += 1
            for start, tags, line in stitched([s for _, s in some[k:end]], found[k:end], sure[k:end]):
                cut_off = end == len(some) and high < len(places) and start + len(tags) == some[-1][1] + WIDTH
                for kind, a, b in tagged_spans(tags[: len(texts[i]) - start]):
                    if not (cut_off and b == len(tags)):
                        span = (kind, start + a, start + b)
                        candidates[i][span] = max(candidates[i].get(span, 0.0), float(line[a:b].min()))
            k = end
    for i, text in enumerate(texts):
        taken = [(a, b) for _, a, b in base[i]]
        for (kind, a, b), sure in sorted(candidates[i].items(), key=lambda x: (-x[1], x[0][1], -x[0][2])):
            if sure < tagger.thresholds[kind] or not acceptable(kind, text, a, b):
                continue
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                out[i].append((kind, a, b))
    return out


def train(docs: DataFrame, text_col: str = "text", windows: int = WINDOWS) -> Tagger:
    """Fit on at most ``windows`` windows of all texts, drawn by hash, half of them with base spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, marked = [], []
            for x in batch.column(0):
                text = x.as_py()
                if text and ANCHOR.search(text):
                    own = [text[s : s + WIDTH] for s in window_starts(text)]
                    parts += own
                    marked += [bool(base_spans(w)) for w in own]
            yield pa.record_batch([pa.array(parts, pa.string()), pa.array(marked, pa.bool_())], names=["part", "marked"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "part string, marked boolean")
    # windows with and without spans are drawn at rates that give about half the sample each
    drawn = parts.distinct().withColumn("h", F.xxhash64("part"))
    half = windows // 2
    counts = {r.marked: r.n for r in drawn.groupBy("marked").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("marked"), min(1.0, half / max(counts.get(True, 0), 1))).otherwise(min(1.0, half / max(counts.get(False, 0), 1)))
    kept = drawn.filter(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).orderBy("h", "part").limit(2 * windows).select("part").collect()
    return fit([r.part for r in kept])


def find_personal(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row; the counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, shared.value)
                columns = [[sum(s[0] == k for s in own) for own in base] for k in range(len(KINDS))]
                yield pa.record_batch(
                    [
                        batch.column(0),
                        *(pa.array(c, pa.int64()) for c in columns),
                        pa.array([hashlib.sha256(span_text(own).encode()).hexdigest() for own in base]),
                        pa.array([span_text(own + new) for own, new in zip(base, more, strict=True)]),
                        pa.array([len(x) for x in more], pa.int64()),
                    ],
                    names=names,
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
