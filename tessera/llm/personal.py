"""Personal data in whole texts: written patterns, and what a character-level BiLSTM with a CRF finds besides.

Patterns (email, ip, card, phone) are matched over every text in one pass whose work is linear in its
length. The network reads characters in both directions, gives each a score for every tag (outside;
begin and inside of each kind), and a CRF's transitions tie the tags of neighbours. It is trained in
numpy, in one task, on at most TRAIN_WINDOWS windows around labelled spans: those of a given table or,
without one, the patterns' own matches in at most TRAIN_DOCS documents of up to TRAIN_BYTES bytes, those
with the least hash. Labelled spans are varied (other digits and letters, other separators, another span
right behind), and windows with dates, prices, versions and other numbers are shown as clean, so
that the network learns kinds by shape and context and can part what the patterns drop: numbers glued
together, separators that no pattern has, numbers without a country code.

Texts are cut into windows of WINDOW characters, STRIDE apart. A span has a digit or an @, so windows
with neither are not decoded, which changes no result. Spans that a window's edge cuts are joined with
those of the next window; then the disjoint set of spans of a text with the most weight is chosen over
all its windows. A span that overlaps one of the patterns, is less than SURE certain, or can't be of its
kind (a card's checksum, an address's parts, the number of digits) is left out.

Edge cases: null, empty and clean texts have no spans; a null doc_id is never trained on; repeated rows
and rows that share a doc_id are rows of their own; a very long text is read whole, windows of it at a
time; without any labelled span nothing is trained and only the patterns count; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.words import arrow_map, texts

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_BYTES, TRAIN_WINDOWS, CLEAN = 2000, 20_000, 3000, 0.3
WINDOW, STRIDE, HIDDEN, BATCH, EPOCHS = 96, 48, 24, 128, 9
#: Windows decoded at once.
DECODED = 512
SURE = 0.6
TAGS = 1 + 2 * len(KINDS)
PAD, BREAK, CONTROL, WIDE, SYMBOLS = 0, 1, 2, 3, 99

# Patterns -----------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _parts(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each starts where the run of a local part's characters before an @ does, or where the match before ends."""
    end, at = 0, text.find("@")
    while at >= 0:
        local = text[end:at]
        start = end + len(local.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _parts(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# The network --------------------------------------------------------------------------------


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.full(len(codes), WIDE, np.int64)
    plain = (codes >= 0x20) & (codes < 0x7F)
    out[plain] = codes[plain].astype(np.int64) - 0x20 + 4
    out[codes < 0x20] = CONTROL
    out[(codes == 10) | (codes == 13)] = BREAK
    return out


def allowed() -> np.ndarray:
    """Inside of a kind only follows begin or inside of it."""
    out = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = False
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return out


ALLOWED = allowed()


class Network:
    """Both directions are the first axis of `inputs`, `again` and `bias`."""

    NAMES = ("inputs", "again", "bias", "out", "base", "steps", "first")

    def __init__(self, seed: int = 0, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(hidden)).astype(np.float32)
        self.inputs, self.again, self.bias = normal(2, SYMBOLS, 4 * hidden), normal(2, hidden, 4 * hidden), np.zeros((2, 1, 4 * hidden), np.float32)
        self.bias[:, :, hidden : 2 * hidden] = 1  # keep what is held
        self.out, self.base = normal(2 * hidden, TAGS), np.zeros(TAGS, np.float32)
        self.steps, self.first = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (n, length, TAGS) of windows x (n, length), and what the gradient needs."""
        n, length = x.shape
        hid = self.again.shape[1]
        both = np.stack([x, x[:, ::-1]])
        given = np.stack([self.inputs[d][both[d].T] for d in (0, 1)], 1) + self.bias[None]  # (length, 2, n, 4 hid)
        h = c = np.zeros((2, n, hid), np.float32)
        gates, cells, outs = np.empty_like(given), np.empty((length, 2, n, hid), np.float32), np.empty((length, 2, n, hid), np.float32)
        for t in range(length):
            z = given[t] + h @ self.again
            g = gates[t]
            g[..., : 3 * hid] = 1 / (1 + np.exp(-z[..., : 3 * hid]))
            g[..., 3 * hid :] = np.tanh(z[..., 3 * hid :])
            c = g[..., hid : 2 * hid] * c + g[..., :hid] * g[..., 3 * hid :]
            h = g[..., 2 * hid : 3 * hid] * np.tanh(c)
            cells[t], outs[t] = c, h
        joined = np.concatenate([outs[:, 0], outs[::-1, 1]], 2)  # (length, n, 2 hid)
        return (joined @ self.out + self.base).transpose(1, 0, 2), (both, gates, cells, outs, joined)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each tag at each place; the expected steps, summed over windows; the log of each window's normaliser."""
        n, length, _ = e.shape
        m = np.exp(self.steps.astype(np.float64)) * ALLOWED
        top = e.max(2, keepdims=True)
        pot = np.exp((e - top).astype(np.float64)).transpose(1, 0, 2)
        pot[0] *= np.exp(self.first)
        alpha, beta, log = np.empty((length, n, TAGS)), np.ones((length, n, TAGS)), top.sum((1, 2)).astype(np.float64)
        a = pot[0]
        for t in range(length):
            a = a if t == 0 else (a @ m) * pot[t]
            size = a.sum(1, keepdims=True)
            log += np.log(size[:, 0])
            a = a / size
            alpha[t] = a
        for t in range(length - 2, -1, -1):
            b = (pot[t + 1] * beta[t + 1]) @ m.T
            beta[t] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        right = pot[1:] * beta[1:]
        scale = np.einsum("tni,ij,tnj->tn", alpha[:-1], m, right, optimize=True)
        pairs = m * np.einsum("tni,tnj->ij", alpha[:-1], right / scale[..., None], optimize=True)
        return p.transpose(1, 0, 2), pairs, log

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        n, length = x.shape
        hid = self.again.shape[1]
        e, (both, gates, cells, outs, joined) = self.emissions(x)
        p, pairs, log = self.marginals(e)
        rows, places = np.arange(n)[:, None], np.arange(length)[None]
        gold = e[rows, places, tags].sum() + self.steps[tags[:, :-1], tags[:, 1:]].sum() + self.first[tags[:, 0]].sum()
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (tags[:, :-1], tags[:, 1:]), 1)
        de = p.copy()
        de[rows, places, tags] -= 1
        first = de[:, 0].sum(0)
        de = de.transpose(1, 0, 2).astype(np.float32)
        grads = {"steps": np.where(ALLOWED, pairs - seen, 0), "first": first, "base": de.sum((0, 1)), "out": np.einsum("tnh,tnk->hk", joined, de, optimize=True)}
        dj = de @ self.out.T
        dh_all = np.stack([dj[..., :hid], dj[::-1, :, hid:]], 1)
        dz_all = np.empty_like(gates)
        dh = dc = np.zeros((2, n, hid), np.float32)
        back = self.again.transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            g = gates[t]
            i, f, o, new = (g[..., k * hid : (k + 1) * hid] for k in range(4))
            dh = dh + dh_all[t]
            tc = np.tanh(cells[t])
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[..., :hid] = dc * new * i * (1 - i)
            dz[..., hid : 2 * hid] = dc * (cells[t - 1] if t else 0) * f * (1 - f)
            dz[..., 2 * hid : 3 * hid] = dh * tc * o * (1 - o)
            dz[..., 3 * hid :] = dc * i * (1 - new * new)
            dh = dz @ back
            dc = dc * f
        before = np.concatenate([np.zeros_like(outs[:1]), outs[:-1]])
        grads["again"] = np.einsum("tdnh,tdnk->dhk", before, dz_all, optimize=True)
        grads["bias"] = dz_all.sum((0, 2))[:, None]
        grads["inputs"] = np.zeros_like(self.inputs)
        for d in (0, 1):
            flat, order = both[d].T.ravel(), None
            order = np.argsort(flat, kind="stable")
            seen_symbols, starts = np.unique(flat[order], return_index=True)
            grads["inputs"][d][seen_symbols] = np.add.reduceat(dz_all[:, d].reshape(-1, 4 * hid)[order], starts)
        return float(log.sum() - gold) / n, {k: v / n for k, v in grads.items()}

    def best(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        n, length, _ = e.shape
        m = np.where(ALLOWED, self.steps, -1e9)
        score, came = e[:, 0] + self.first, np.empty((length, n, TAGS), np.int8)
        for t in range(1, length):
            ways = score[:, :, None] + m
            came[t] = ways.argmax(1)
            score = ways.max(1) + e[:, t]
        out = np.empty((n, length), np.int64)
        out[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = came[t][np.arange(n), out[:, t]]
        return out


def fit(x: np.ndarray, tags: np.ndarray, seed: int = 0) -> Network:
    """By Adam, in batches of windows."""
    net, rng = Network(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(getattr(net, k), np.float64) for k in net.NAMES}
    square, step, total = {k: v.copy() for k, v in mean.items()}, 0, EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            _, grads = net.gradient(x[order[a : a + BATCH]], tags[order[a : a + BATCH]])
            size = np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values()))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total) * min(1, step / 5)
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                setattr(net, k, (getattr(net, k) - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return net


# Training windows ---------------------------------------------------------------------------


def _some_digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def varied(kind: int, span: str, rng: np.random.Generator) -> str:
    """Another span of the kind: other digits and letters, now and then another form."""
    d = lambda n: _some_digits(rng, n)
    fresh = lambda s: re.sub("[a-z]", lambda _: chr(97 + int(rng.integers(26))), DIGIT.sub(lambda _: d(1), s))
    other = rng.random() < 0.4
    if kind == 0:
        local, _, host = span.rpartition("@")
        span = fresh(local) + "@" + (host if rng.random() < 0.5 else fresh(host))
        return span.replace("@", str(rng.choice([" @ ", "@ ", " @"]))) if other and rng.random() < 0.4 else span.upper() if other and rng.random() < 0.3 else span
    if kind == 1:
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        return str(rng.choice([" ", "-", "."])).join(d(4) for _ in range(4)) if other else fresh(span)
    forms = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)}/{d(3)}/{d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}"]
    return str(rng.choice(forms)) if other else fresh(span)


def clean_number(rng: np.random.Generator) -> str:
    d = lambda n: _some_digits(rng, n)
    forms = [
        f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(10, 99)}",
        f"{rng.integers(0, 24)}:{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{rng.integers(1, 999)},{d(3)}.{d(2)}", f"${rng.integers(1, 9999)}.{d(2)}", d(int(rng.integers(1, 13))), d(int(rng.integers(20, 30))), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        f"{rng.integers(1900, 2100)}-{rng.integers(1900, 2100)}", f"{d(2)}%", f"@{chr(97 + int(rng.integers(26)))}{d(2)}", f"v{d(1)}.{d(2)}", f"#{d(5)}", f"{d(2)}x{d(2)}", f"{d(2)} - {d(2)}",
    ]
    return str(rng.choice(forms))


def windows_for(sample: list[tuple[str, list[tuple[int, int, int]]]], count: int = TRAIN_WINDOWS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (count, WINDOW) from texts with their labelled spans (start, kind, end)."""
    rng = np.random.default_rng(seed)
    at = [(i, j) for i, (_, spans) in enumerate(sample) for j in range(len(spans))]
    x, y = np.zeros((count, WINDOW), np.int64), np.zeros((count, WINDOW), np.int64)

    def cut(parts: list[tuple[str, int]], lead: int) -> tuple[np.ndarray, np.ndarray]:
        tags = [np.full(len(s), 0 if kind < 0 else 2 * kind + 2) for s, kind in parts]
        for t, (_, kind) in zip(tags, parts, strict=True):
            if kind >= 0 and len(t):
                t[0] = 2 * kind + 1
        return symbols_of("".join(s for s, _ in parts))[lead : lead + WINDOW], np.concatenate(tags)[lead : lead + WINDOW]

    def around(text: str, spans: list, a: int, z: int) -> list[tuple[str, int]]:
        parts, here = [], a
        for s, kind, e in spans:
            if s >= here and e <= z:
                parts += [(text[here:s], -1), (text[s:e], kind)]
                here = e
        return [*parts, (text[here:z], -1)]

    for row in range(count):
        if rng.random() < CLEAN:
            text, spans = sample[int(rng.integers(len(sample)))]
            place = int(rng.integers(len(text) + 1))
            near = [s for s in spans if s[2] <= place or s[0] >= place]
            inside = [s for s in spans if s[0] < place < s[2]]
            place = inside[0][2] if inside else place
            middle = [(str(rng.choice([" ", "", ", "])) + clean_number(rng) + str(rng.choice([" ", ". ", ", "])), -1)] if rng.random() < 0.8 else []
        else:
            i, j = at[int(rng.integers(len(at)))]
            text, spans = sample[i]
            place, kind, end = spans[j]
            near = spans
            middle = [(varied(kind, text[place:end], rng), kind)]
            if rng.random() < 0.4:
                o, k = at[int(rng.integers(len(at)))]
                s, other, e = sample[o][1][k]
                middle += [(str(rng.choice([" ", " ", ", ", "; ", " / "])), -1), (varied(other, sample[o][0][s:e], rng), other)]
            text = text[:place] + text[end:]
            near = [(s, k, e) if e <= place else (s - end + place, k, e - end + place) for s, k, e in near if e <= place or s >= end]
        parts = around(text, near, max(0, place - WINDOW), place) + middle + around(text, near, place, place + WINDOW)
        size = sum(len(s) for s, _ in parts)
        symbols, tags = cut(parts, int(rng.integers(max(1, min(size, 2 * WINDOW) - WINDOW + 1))))
        x[row, : len(symbols)], y[row, : len(tags)] = symbols, tags
    return x, y


# Decoding -----------------------------------------------------------------------------------


def sound(kind: int, span: str) -> bool:
    """Whether a span can be of its kind at all."""
    digits = _digits(span)
    if kind == 0:
        return span.count("@") == 1 and bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@.]+(?: ?\. ?[^\s@.]+)+", span))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span)) and _parts(span)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9 .-]+", span)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[0-9 ().+/-]+", span)) and 9 <= len(digits) <= 15


def window_spans(tags: np.ndarray, surety: np.ndarray, at: int, n: int, length: int) -> Iterator[list]:
    """[start, end, kind, certainty, cut before, cut after] of a window at place `at` that holds n characters of a text of `length`."""
    i = 0
    while i < n:
        if tags[i] == 0:
            i += 1
            continue
        kind, z = (tags[i] - 1) // 2, i + 1
        while z < n and tags[z] == 2 * kind + 2:
            z += 1
        yield [at + i, at + z, int(kind), float(surety[i:z, kind].mean()), i == 0 and at > 0, z == n and at + n < length]
        i = z


def reconciled(found: list[list], text: str, fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, certainty): the disjoint spans of most weight among those of all windows, clear of the fixed ones."""
    joined: list[list] = []
    whole = {k: sorted((s[0], s[1]) for s in found if s[2] == k and not s[4] and not s[5]) for k in range(len(KINDS))}
    for s in sorted(found):
        if s[4] or s[5]:  # a window has it whole, or it goes on in the next one's
            k = bisect_left(whole[s[2]], (s[1],))
            if any(a < s[1] and s[0] < z for a, z in whole[s[2]][max(0, k - 3) : k]):
                continue
            last = next((o for o in reversed(joined[-3:]) if o[2] == s[2] and o[5] and s[0] < o[1]), None)
            if last:
                last[1], last[3], last[5] = max(last[1], s[1]), min(last[3], s[3]), s[5] if s[1] >= last[1] else last[5]
                continue
        joined.append(s)
    able, edges = {}, np.array(sorted((z, a) for a, _, z in fixed), np.int64).reshape(-1, 2)
    for a, z, kind, sure, *_ in joined:
        piece = text[a:z]
        a, z = a + len(piece) - len(piece.lstrip(" \t\n.,;:/-")), z - len(piece) + len(piece.rstrip(" \t\n.,;:/-"))
        if a >= z or sure < SURE or not sound(kind, text[a:z]):
            continue
        k = np.searchsorted(edges[:, 0], a, "right")
        if not (k < len(edges) and edges[k:, 1].min() < z):
            able[a, z, kind] = max(sure, able.get((a, z, kind), 0))
    spans = sorted((z, a, kind, sure) for (a, z, kind), sure in able.items())
    ends, total, last = [s[0] for s in spans], [0.0], [None]
    for z, a, _, sure in spans:
        k = int(np.searchsorted(ends, a, "right"))
        with_it = total[min(k, len(total) - 1)] + sure * (z - a)
        total.append(max(total[-1], with_it))
        last.append(min(k, len(total) - 2) if with_it > total[-2] else None)
    out, i = [], len(spans)
    while i:
        if last[i] is None:
            i -= 1
        else:
            z, a, kind, sure = spans[i - 1]
            out.append((a, kind, z, sure))
            i = last[i]
    return out[::-1]


def added(net: Network, batch: list[str], fixed: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int, float]]]:
    """What the network finds in each text besides the fixed spans."""
    found: list[list] = [[] for _ in batch]
    x, owner, at = np.zeros((DECODED, WINDOW), np.int64), [], []

    def decode() -> None:
        e, _ = net.emissions(x[: len(owner)])
        tags, p = net.best(e), net.marginals(e)[0]
        surety = p[:, :, 1::2] + p[:, :, 2::2]
        for row, (i, a) in enumerate(zip(owner, at, strict=True)):
            if tags[row].any():
                found[i] += window_spans(tags[row], surety[row], a, min(WINDOW, len(batch[i]) - a), len(batch[i]))
        owner.clear()
        at.clear()

    for i, text in enumerate(batch):
        symbols = symbols_of(text)
        anchors = np.flatnonzero(((symbols >= 20) & (symbols < 30)) | (symbols == 36))  # 0 to 9, @
        last = max(0, -(-(len(symbols) - WINDOW) // STRIDE))
        k = np.unique(np.concatenate([(anchors // STRIDE - back) for back in range(-(-WINDOW // STRIDE))]))
        for a in (k[(k >= 0) & (k <= last)] * STRIDE).tolist():
            piece = symbols[a : a + WINDOW]
            x[len(owner)] = PAD
            x[len(owner), : len(piece)] = piece
            owner.append(i)
            at.append(a)
            if len(owner) == DECODED:
                decode()
    if owner:
        decode()
    return [reconciled(f, t, s) if f else [] for f, t, s in zip(found, batch, fixed, strict=True)]


# On tables ----------------------------------------------------------------------------------


def train(docs: DataFrame, spans: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """In one task, to which a bounded sample comes. spans: doc_id, kind, start, end (code points, end exclusive); None for the patterns' matches."""
    able = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and octet_length(text) <= " + str(TRAIN_BYTES))
    if spans is None:
        able = able.where(F.col("text").rlike("[0-9@]")).withColumn("marks", F.lit(None).cast("array<struct<a: long, kind: string, z: long>>"))
    else:
        marks = spans.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_set(F.struct(F.col("start").cast("long").alias("a"), F.col("kind"), F.col("end").cast("long").alias("z"))).alias("marks"))
        able = able.join(marks, "doc_id")
    hashed = F.xxhash64("doc_id", "text")
    # about twice as many as are taken, so that one task doesn't get as many rows from every other
    least = int(min(1.0, 2 * TRAIN_DOCS / max(1, able.count())) * 2**64) - 2**63 - 1
    sample = able.where(hashed <= F.lit(least)).orderBy(hashed, "doc_id", "text").limit(TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {}
        for b in batches:
            for text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[text] = patterns(text) if marks is None else sorted((m["a"], KINDS.index(m["kind"]), m["z"]) for m in marks)
        sample = sorted(held.items())
        if any(s for _, s in sample):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*windows_for(sample)))], pa.binary())], names=["model"])

    found = sample.select("text", "marks").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else None


def tagged(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (start, kind, end, base: whether a pattern found it, certainty), by start and kind."""
    small_batches(docs.sparkSession)
    one = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("certainty", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(one))])

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        batch = texts(b.column(1)).to_pylist()
        base = [patterns(t) for t in batch]
        more = added(net, batch, base) if net else [[] for _ in batch]
        spans = [sorted([(*s, True, 1.0) for s in f] + [(a, k, z, False, c) for a, k, z, c in m]) for f, m in zip(base, more, strict=True)]
        made = [[dict(zip(("start", "kind", "end", "base", "certainty"), s, strict=True)) for s in mine] for mine in spans]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(made, schema.field(1).type)], schema=schema)

    ddl = "doc_id long, spans array<struct<start: long, kind: int, end: long, base: boolean, certainty: double>>"
    out = arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema, ddl, 1)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda s: F.struct(s["start"].alias("start"), kinds[s["kind"]].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), s["certainty"].alias("certainty"))
    return out.select("doc_id", F.transform("spans", named).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the patterns'), base_sha256, spans (all, kind:start:end), n_added."""
    found = tagged(docs, train(docs, None, id_col, text_col), id_col, text_col)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long) as n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
