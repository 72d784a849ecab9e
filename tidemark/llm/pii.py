"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is written and trained here in numpy from labelled spans. Texts are read in
overlapping windows of ``SPAN`` characters, every ``STEP``; where two windows overlap the
emission scores are averaged, weighted by the distance to the window's edge, and the best path of
tags over the whole text gives spans that agree globally. Every window of every text is encoded. A
span must hold a digit or ``@``. Tagged spans that meet a base span are dropped; the rest are
added.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
SPAN, STEP = 64, 48
OVER = SPAN - STEP
#: So many windows are encoded side by side, and texts of about so many characters decoded together.
WIDE, SIDE = 2000, 1_000_000
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

# The base patterns. A digit before cannot begin a match of its own: the run it belongs to was
# tried from its first digit. An email is found from its @ backwards, which takes linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed; leftmost and non-overlapping per kind."""
    if not _HINT.search(text):
        return []
    out, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            i = m.start()
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append((i, last := m.end(), "email"))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the tagger

#: Symbols: one each for lower case, upper case, other letters, digits, white space and line
#: ends, one for each of these marks, one for the rest, and 0 for padding.
_MARKS = "@.-+()_%:/,;'\"!#"
N_SYMBOLS = 7 + len(_MARKS) + 1
N_TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 8, 12
_ASCII = np.full(128, N_SYMBOLS - 1, np.int8)
for _c in range(128):
    _ch = chr(_c)
    _ASCII[_c] = 1 if _ch.islower() else 2 if _ch.isupper() else 4 if _ch.isdigit() else 6 if _ch in "\n\r" else 5 if _ch.isspace() else 7 + _MARKS.index(_ch) if _ch in _MARKS else N_SYMBOLS - 1


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], np.int8(3))


def _allowed() -> np.ndarray:
    """CRF transitions: an inside tag follows the begin or inside tag of its kind only."""
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_FORBID = np.where(_allowed(), 0.0, -1e4)
_START = np.array([0.0] + [0.0, -1e4] * len(KINDS))


#: Where the squashing function reaches one.
_FULL = 2.322185


def _squash(x: np.ndarray, a: np.ndarray) -> None:
    """In place, a fraction near the hyperbolic tangent that takes a fifth of its time; ``a`` is room of the same shape."""
    # The fraction x (15 + x x) / (15 + 6 x x), as its whole part and the rest.
    np.clip(x, -_FULL, _FULL, out=x)
    np.multiply(x, x, out=a)
    a += 2.5
    np.divide(12.5 / 6, a, out=a)
    a += 1 / 6
    x *= a


def _squashed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same function's values and slopes."""
    c = np.clip(x, -_FULL, _FULL)
    q = c * c
    under = 15 + 6 * q
    return c * (15 + q) / under, np.where(np.abs(x) < _FULL, (225 - 45 * q + 6 * q * q) / (under * under), 0.0)


class Tagger:
    """Parameters and passes of the network."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.p = {"embed": draw.normal(0, 0.5, (N_SYMBOLS, EMBED)), "out": draw.normal(0, 0.3, (2 * HIDDEN, N_TAGS)), "bias": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS))}
        for d in "fb":
            self.p[d] = draw.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
            self.p[d + "0"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _lstm(self, x: np.ndarray, d: str, cache: list | None = None) -> np.ndarray:
        n, length, _ = x.shape
        into = x @ self.p[d][:EMBED] + self.p[d + "0"]
        again = self.p[d][EMBED:]
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out = np.empty((n, length, HIDDEN), x.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            g = into[:, t] + h @ again
            # A gate is a half more than half the squashed half.
            (gate, steep), (new, rise) = _squashed(0.5 * g[:, : 3 * HIDDEN]), _squashed(g[:, 3 * HIDDEN :])
            gate = 0.5 + 0.5 * gate
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            was, hw = c, h
            c = f * c + i * new
            tc, bend = _squashed(c)
            h = o * tc
            out[:, t] = h
            if cache is not None:
                cache.append((t, i, f, o, new, was, tc, hw, 0.25 * steep, rise, bend))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["embed"][ids]
        return np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], axis=2) @ self.p["out"] + self.p["bias"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths, and its gradients."""
        n, length = ids.shape
        x, caches = self.p["embed"][ids], {"f": [], "b": []}
        hid = np.concatenate([self._lstm(x, d, caches[d]) for d in "fb"], axis=2)
        e = hid @ self.p["out"] + self.p["bias"]
        a = self.p["trans"] + _FORBID
        alpha = np.empty((n, length, N_TAGS))
        alpha[:, 0] = e[:, 0] + _START
        lse = lambda v, ax: (m := v.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(axis=ax))
        for t in range(1, length):
            alpha[:, t] = e[:, t] + lse(alpha[:, t - 1, :, None] + a, 1)
        z = lse(alpha[:, -1], 1)
        beta, ga = np.zeros((n, N_TAGS)), np.zeros_like(a)
        ge = np.empty_like(e)
        at = np.arange(n)
        for t in range(length - 1, -1, -1):
            ge[:, t] = np.exp(alpha[:, t] + beta - z[:, None])
            if t:
                pair = np.exp(alpha[:, t - 1, :, None] + a + (e[:, t] + beta)[:, None, :] - z[:, None, None])
                ga += pair.sum(axis=0)
                np.subtract.at(ga, (tags[:, t - 1], tags[:, t]), 1)
                beta = lse(a[None] + (e[:, t] + beta)[:, None, :], 2)
        gold = np.take_along_axis(e, tags[:, :, None], 2).sum(axis=(1, 2)) + a[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        for t in range(length):
            ge[at, t, tags[:, t]] -= 1
        ge, ga = ge / n, ga / n
        g = {"trans": ga, "bias": ge.sum(axis=(0, 1)), "out": np.einsum("ntd,ntk->dk", hid, ge)}
        gh, gx = ge @ self.p["out"].T, np.zeros_like(x)
        for d, part in (("f", gh[:, :, :HIDDEN]), ("b", gh[:, :, HIDDEN:])):
            gw, gb, dh, dc = np.zeros_like(self.p[d]), np.zeros(4 * HIDDEN), 0.0, 0.0
            for t, i, f, o, new, was, tc, hw, steep, rise, bend in reversed(caches[d]):
                h = part[:, t] + dh
                c = dc + h * o * bend
                gate = np.concatenate([np.concatenate([c * new, c * was, h * tc], axis=1) * steep, c * i * rise], axis=1)
                gw[:EMBED] += x[:, t].T @ gate
                gw[EMBED:] += hw.T @ gate
                gb += gate.sum(axis=0)
                back = gate @ self.p[d].T
                gx[:, t] += back[:, :EMBED]
                dh, dc = back[:, EMBED:], c * f
            g[d], g[d + "0"] = gw, gb
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids, gx)
        return float((z - gold).mean()), g


def tags_of(length: int, spans: Sequence[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def labelled_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up prose with one planted span or none, and look-alikes that are none, of ``SPAN`` characters at least."""
    draw = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    letters = "abcdefghijklmnopqrstuvwxyzéüßñ"
    word = lambda: "".join(letters[i] for i in draw.integers(0, len(letters) - 4 * (draw.random() < 0.8), draw.integers(1, 10)))
    name = lambda: re.sub("[^a-z]", "x", word())

    def cased() -> str:
        w = word()
        return (w.capitalize() if draw.random() < 0.15 else w.upper() if draw.random() < 0.1 else w) + ("", ".", ",", "!!", ":")[draw.choice(5, p=[0.76, 0.08, 0.08, 0.04, 0.04])]

    def card() -> str:
        s = digits(15)
        s += next(c for c in "0123456789" if luhn(s + c))
        return " ".join(s[i : i + 4] for i in range(0, 16, 4)) if draw.random() < 0.25 else "-".join(s[i : i + 4] for i in range(0, 16, 4)) if draw.random() < 0.2 else s

    make = {
        "email": lambda: f"{name()}{('.', '_', '-', '')[draw.integers(4)]}{digits(draw.integers(0, 3)) or name()}@{name()}{digits(draw.integers(0, 2))}.{f'{name()}.' * int(draw.integers(2))}{('com', 'org', 'net', 'de', 'fr', 'es', 'io')[draw.integers(7)]}",
        "ip": lambda: ".".join(str(draw.integers(0, 256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+{draw.integers(1, 99)}{(' (', ' ', '-')[q := draw.integers(3)]}{digits(3)}{(') ', ' ', '-')[q]}{digits(3)}{' -'[draw.integers(2)]}{digits(4)}",
        "none": lambda: (f"{digits(draw.integers(1, 9))}", f"{digits(2)}.{digits(1)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}", "".join("0123456789abcdef"[i] for i in draw.integers(0, 16, 40)), f"@{name()}", f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(25)}")[draw.integers(8)],
    }
    out = []
    for _ in range(n):
        kind = (*KINDS, "none")[draw.integers(5)]
        left, right = " ".join(cased() for _ in range(draw.integers(0, 7))), " ".join(cased() for _ in range(14))
        left += " " * bool(left)
        thing = make[kind]()
        mark = ("", ".", ",", "!!", "###", '"')[draw.choice(6, p=[0.6, 0.1, 0.1, 0.08, 0.06, 0.06])]
        out.append((left + thing + mark + " " + right + " " * SPAN, [] if kind == "none" else [(len(left), len(left) + len(thing), kind)]))
    return out


@lru_cache(maxsize=2)
def trained(seed: int = 1, n: int = 4096, epochs: int = 6, batch: int = 64) -> Tagger:
    """A tagger fitted to ``labelled_texts``; windows start anywhere in them, so edges cut spans too."""
    return fit(labelled_texts(n, seed), seed, epochs, batch)


def fit(texts: Sequence[tuple[str, list[tuple[int, int, str]]]], seed: int = 1, epochs: int = 6, batch: int = 64) -> Tagger:
    net, draw = Tagger(seed), np.random.default_rng(seed + 1)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    rows = [(symbols(t), tags_of(len(t), s)) for t, s in texts if len(t) >= SPAN]
    total = epochs * (len(rows) // batch)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows) - batch + 1, batch):
            ids, tags = [], []
            for i in order[at : at + batch].tolist():
                x, y = rows[i]
                s = int(draw.integers(0, min(len(x) - SPAN, 48) + 1))
                y = y[s : s + SPAN].copy()
                if y[0] and y[0] % 2 == 0:
                    y[0] -= 1
                ids.append(x[s : s + SPAN])
                tags.append(y)
            _, g = net.gradients(np.stack(ids).astype(np.int64), np.stack(tags))
            step += 1
            rate = 0.02 * (1 - step / (total + 1)) + 5e-4
            for k, x in net.p.items():
                d = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    net.p = {k: x.astype(np.float32) for k, x in net.p.items()}
    return net


class Decoder:
    """Encodes every window of texts, and finds for each whole text the best path of tags.

    No path but the best is wanted, and that is outside of all spans nearly everywhere: where a
    bound shows that any span over a character, whatever its ends and tags, scores less than
    none, the best path is outside there. Viterbi passes run over the stretches that are left,
    whose ends are so known; the result is that of one pass over the whole text.
    """

    def __init__(self, net: Tagger):
        half = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)]
        self.table = [((net.p["embed"] @ net.p[d][:EMBED] + net.p[d + "0"]) * half).T.astype(np.float32).copy() for d in "fb"]
        # The state is held doubled, as the output gate comes without its half.
        self.again = [(net.p[d][EMBED:] * half / 2).T.astype(np.float32).copy() for d in "fb"]
        self.out = [net.p["out"][k * HIDDEN : (k + 1) * HIDDEN].T.astype(np.float32) / 2 for k in (0, 1)]
        self.bias = net.p["bias"].astype(np.float32)
        # Taking a number from all transitions changes no comparison of paths.
        self.trans = (net.p["trans"] - net.p["trans"][0, 0] + _FORBID).astype(np.float32)
        self.near = (np.minimum(np.minimum(np.arange(1, SPAN + 1), np.arange(SPAN, 0, -1)), OVER + 1) / (OVER + 1)).astype(np.float32)[:, None]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores ``[window, SPAN, tag]`` of symbols ``[window, SPAN]``, weighted by the distance to the window's edge."""
        n, k = len(ids), HIDDEN
        ids = np.ascontiguousarray(ids.T, np.int64)
        states = np.empty((SPAN, 2, k, n), np.float32)
        g, a = (np.empty((4 * k, n), np.float32) for _ in range(2))
        into = np.empty_like(g)
        for d, steps in enumerate((range(SPAN), range(SPAN - 1, -1, -1))):
            h, c = np.zeros((k, n), np.float32), np.zeros((k, n), np.float32)
            for t in steps:
                self.table[d].take(ids[t], axis=1, out=into, mode="clip")
                np.matmul(self.again[d], h, out=g)
                g += into
                _squash(g, a)
                gate = g[: 3 * k]
                gate += 1
                c *= gate[k : 2 * k]
                np.multiply(gate[:k], g[3 * k :], out=a[:k])
                c += a[:k]
                c *= 0.5
                h = states[t, d]
                np.copyto(h, c)
                _squash(h, a[:k])
                h *= gate[2 * k :]
        e = np.matmul(np.concatenate(self.out, axis=1), states.reshape(SPAN, 2 * k, n))
        e += self.bias[:, None]
        e *= self.near[:, None]
        return np.ascontiguousarray(e.reshape(SPAN * N_TAGS, n).T).reshape(n, SPAN, N_TAGS)

    def emissions(self, parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores ``[character, tag]`` of all texts, each with padding to a step and one step more, and where each begins."""
        blocks = np.array([-(-len(p) // STEP) for p in parts])
        begin = np.concatenate([[0], np.cumsum(blocks + 1)])
        ids = np.zeros((begin[-1] + 1, STEP), np.int8)
        for p, at in zip(parts, begin.tolist(), strict=False):
            ids.reshape(-1)[at * STEP : at * STEP + len(p)] = p
        e = np.zeros((begin[-1] + 1, STEP, N_TAGS), np.float32)
        whole = np.ones(len(ids), bool)
        whole[begin[1:] - 1] = whole[-1] = False
        whole = np.flatnonzero(whole)
        over = np.empty((len(whole), OVER, N_TAGS), np.float32)
        for at in range(0, len(whole), WIDE):
            w = whole[at : at + WIDE]
            s = self.scores(np.concatenate([ids[w], ids[w + 1, :OVER]], axis=1))
            e[w] = s[:, :STEP]
            over[at : at + WIDE] = s[:, STEP:]
        e[whole + 1, :OVER] += over
        first = begin[:-1][blocks > 0]
        e[first] /= self.near[:STEP]  # no window comes before a text's first
        return e.reshape(-1, N_TAGS), begin * STEP

    def islands(self, e: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches outside of which the best path is surely in no span."""
        t = self.trans
        between = float(t[1:, 1:].max())
        gain = e[:, 1].copy()
        for j in range(2, N_TAGS):
            np.maximum(gain, e[:, j], out=gain)
        gain = (gain - e[:, 0]).astype(np.float64) + between
        real = np.zeros(len(e) + 1, np.int64)
        np.add.at(real, begin[:-1], 1)
        np.add.at(real, begin[:-1] + sizes, -1)
        real = np.cumsum(real[:-1]) > 0
        gain[~real] = -1e4
        total = np.cumsum(gain)
        most = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        ends = max(float(t[0, 1:].max()), 0.0) + max(float(t[1:, 0].max()), 0.0) - between
        edge = np.flatnonzero(np.diff(np.concatenate([[False], real & (most + ends >= -0.01), [False]]).astype(np.int8)))
        return edge[::2], edge[1::2]

    def best(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """Best tags ``[place, stretch]`` of stretches that follow and precede a character outside, but for those that open or close a text."""
        size = ends - starts
        n, length = len(size), int(size.max())
        at = np.minimum(starts + np.arange(length)[:, None], ends - 1)
        alpha = np.empty((length, N_TAGS, n), np.float32)
        alpha[0] = e[starts].T + np.where(opening, _START.astype(np.float32)[:, None], self.trans[0][:, None])
        for t in range(1, length):
            np.add((alpha[t - 1][:, None] + self.trans[:, :, None]).max(axis=0), e[at[t]].T, out=alpha[t])
        out = np.zeros((length, n), np.int8)
        last = np.where(closing, np.float32(0), self.trans[:, :1])
        for t in range(length - 1, -1, -1):
            out[t] = (alpha[t] + np.where(t == size - 1, last, self.trans[:, out[min(t + 1, length - 1)]])).argmax(axis=0)
            out[t][t >= size] = 0
        return out


def tagged_spans(texts: Sequence[str], net: Tagger | Decoder) -> list[list[tuple[int, int, str]]]:
    """The tagger's spans in each text, by start. Memory goes with the text's length, about 60 bytes a character."""
    decoder = net if isinstance(net, Decoder) else Decoder(net)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        parts = [symbols(texts[at])]
        size = len(parts[0])
        while at + len(parts) < len(texts) and size < SIDE:
            parts.append(symbols(texts[at + len(parts)]))
            size += len(parts[-1])
        for k, found in enumerate(_decoded(decoder, parts), at):
            out[k] = found
        at += len(parts)
    return out


def _decoded(decoder: Decoder, parts: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
    out: list[list[tuple[int, int, str]]] = [[] for _ in parts]
    sizes = np.array([len(p) for p in parts])
    e, begin = decoder.emissions(parts)
    starts, ends = decoder.islands(e, begin, sizes)
    text = np.searchsorted(begin, starts, "right") - 1
    # Empty texts begin where the next one does, after a step of padding, so none is taken for another.
    order, at = np.argsort(ends - starts, kind="stable"), 0
    size = (ends - starts)[order]
    while at < len(order):
        n = int(np.searchsorted(size, max(16, 5 * size[at] // 4), "right"))
        n = max(at + 1, min(n, at + SIDE // max(16, 5 * int(size[at]) // 4)))
        group, at = order[at:n], n
        paths = decoder.best(e, starts[group], ends[group], starts[group] == begin[text[group]], ends[group] == begin[text[group]] + sizes[text[group]])
        for i in np.flatnonzero(paths.any(axis=0)).tolist():
            k, path = text[group[i]], paths[:, i]
            shift = int(starts[group[i]] - begin[k])
            for s in np.flatnonzero((path > 0) & (path % 2 == 1)).tolist():
                inside = path[s] + 1
                t = s + 1
                while t < len(path) and path[t] == inside:
                    t += 1
                if np.isin(parts[k][shift + s : shift + t], (4, 7)).any():
                    out[k].append((shift + s, shift + t, KINDS[(inside - 2) // 2]))
    return [sorted(x) for x in out]


def find_pii(docs: DataFrame, *, text_col: str = "text", net: Tagger | None = None) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``added`` put last: arrays of (kind, start, end).

    Positions are code points, ends exclusive; ``base`` goes by start and then kind, ``added``
    are the tagger's spans that meet no base span. Null or empty text: none. Repeated rows get
    the same spans. Empty input: no rows. Input columns named ``base`` or ``added`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net or trained())
    kept = [c for c in docs.columns if c not in ("base", "added")]
    named = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]

    def find(rows: dict, decoder: Decoder) -> dict:
        found = both([t or "" for t in rows[text_col]], decoder)
        return {c: rows[c] for c in kept} | {"base": [named(x) for x, _ in found], "added": [named(x) for _, x in found]}

    spans = T._parse_datatype_string(SPANS)
    return map_rows(docs, find, T.StructType([docs.schema[c] for c in kept]).add("base", spans).add("added", spans), lambda: Decoder(sent.value))


def both(texts: Sequence[str], net: Tagger | Decoder) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Base spans of each text, and the tagger's that meet none of them."""
    base = [base_spans(t) for t in texts]
    return [(have, _apart(found, have)) for found, have in zip(tagged_spans(texts, net), base, strict=True)]


def _apart(found: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of ``found`` (ordered, apart from each other) that meet no span of ``base`` (ordered by start)."""
    out, reach, i = [], 0, 0
    for s in found:
        while i < len(base) and base[i][0] < s[1]:
            reach = max(reach, base[i][1])
            i += 1
        if reach <= s[0]:
            out.append(s)
    return out


def redact_text(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """``text`` with each span put as ``<kind>``; spans that overlap go as the first of them."""
    out, at, done = [], 0, 0
    for a, b, kind in sorted(spans):
        if a >= done:
            out += [text[at:a], f"<{kind}>"]
        at = done = max(done, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", net: Tagger | None = None) -> DataFrame:
    """``docs`` with base and added spans of ``text_col`` replaced by their kinds; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(net or trained())

    def run(rows: dict, decoder: Decoder) -> dict:
        texts = [t or "" for t in rows[text_col]]
        new = [redact_text(t, [*base, *added]) for t, (base, added) in zip(texts, both(texts, decoder), strict=True)]
        return rows | {text_col: [None if t is None else n for t, n in zip(rows[text_col], new, strict=True)]}

    return map_rows(docs, run, docs.schema, lambda: Decoder(sent.value))
