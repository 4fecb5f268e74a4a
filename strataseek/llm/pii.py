"""Personal data in text: fixed base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans
the patterns miss (phones without a plus, other separators, spelled-out addresses).

The net is trained in numpy from generated labelled spans (seeded, the same in every run). Text is cut into overlapping
windows; each is decoded by Viterbi; spans that touch an inner window edge are left to the neighbour that holds them
whole, or where none does, to a window of LONG characters around the edge; the rest of a document's spans is reconciled at
once by weighted interval scheduling. What is personal data the net says; an added span besides passes its kind's check (its
digits' number, range or check digit, an address's parts) and touches no base span.

A window that has neither an at sign nor four digits can't hold a span that passes a check, so it isn't decoded; the
result is that of decoding every window. Null texts are empty. Positions count code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, lean, same_columns

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Characters in a window, its step, windows decoded at a time.
WINDOW, STEP, BATCH = 192, 112, 256
#: Characters in a window around a span that no window holds whole.
LONG = 640
EMBED, HIDDEN = 10, 16

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """As the pattern finds them, in one pass: the run of local characters before each at sign, from the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


# Checks of added spans: what is written for an at sign or a dot counts as one.
_AT, _DOT = re.compile(r" ?(?:@|[\[({] ?at ?[\])}]) ?", re.I), re.compile(r" ?(?:\.|[\[({] ?(?:dot|\.) ?[\])}]) ?", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")


def passes(kind: int, text: str) -> bool:
    if kind == 0:
        local, at, host = _DOT.sub(".", _AT.sub("@", text)).partition("@")
        return bool(local and at) and not re.search(r"[\s@]", local + host) and re.fullmatch(r"[^.]+(?:\.[^.]+)*\.[A-Za-z]{2,}", host) is not None
    if any(c.isalpha() for c in text):
        return False
    digits, groups = _digits(text), re.findall("[0-9]+", text)
    if kind == 1:
        return len(groups) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in groups)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(groups) >= 2 and not _DATE.match(text)


# Characters: ASCII as they are, letters beyond it as one, all else as one.
def codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, x, np.where(x < 0x2000, 128, 129)).astype(np.int64)


class Net:
    """Embedding, one LSTM each way, linear emissions, CRF transitions; forward, training and decoding."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": f(131, EMBED) * 3, "out": f(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "lr":
            self.p |= {f"wx{d}": f(EMBED, 4 * HIDDEN), f"wh{d}": f(HIDDEN, 4 * HIDDEN), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}
        self.bar = np.zeros((TAGS, TAGS), np.float32)  # I follows B or I of its kind only
        for k in range(len(KINDS)):
            for t in range(TAGS):
                if t not in (1 + 2 * k, 2 + 2 * k):
                    self.bar[t, 2 + 2 * k] = -1e4
        self.bar_first = np.array([-1e4 if t and t % 2 == 0 else 0 for t in range(TAGS)], np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        pre = x.reshape(-1, EMBED) @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        pre = pre.reshape(steps, n, -1)
        hs, kept, wh = np.empty((steps, n, HIDDEN), np.float32), [], self.p[f"wh{d}"]
        for t in range(steps) if d == "l" else range(steps - 1, -1, -1):
            z = pre[t] + h @ wh
            # a sigmoid is half a tanh of half its input and a half
            z[:, : 3 * HIDDEN] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * HIDDEN] = z[:, : 3 * HIDDEN] * 0.5 + 0.5
            i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                kept.append((t, z, before, tc))
        return hs, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: (windows, steps) character codes, 130 past the end -> (steps, windows, tags)."""
        e = self.p["e"][x.T]
        (l, kl), (r, kr) = self._lstm(e, "l", keep), self._lstm(e, "r", keep)
        both = np.concatenate([l, r], axis=2)
        return both @ self.p["out"] + self.p["out_b"], (e, both, kl, kr)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the CRF and its gradients, by forward-backward and back-propagation."""
        em, (e, both, kl, kr) = self.emissions(x, True)
        steps, n, _ = em.shape
        trans, first = self.p["trans"] + self.bar, self.p["first"] + self.bar_first
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        fw, bw = np.empty_like(em), np.zeros_like(em)
        fw[0] = first + em[0]
        for t in range(1, steps):
            fw[t] = lse(fw[t - 1][:, :, None] + trans, 1) + em[t]
        for t in range(steps - 2, -1, -1):
            bw[t] = lse(trans + (em[t + 1] + bw[t + 1])[:, None, :], 2)
        z = lse(fw[-1], 1)
        yt = y.T
        ix = np.arange(n)
        gold = first[yt[0]] + em[np.arange(steps)[:, None], ix, yt].sum(0) + trans[yt[:-1], yt[1:]].sum(0)
        d_em = np.exp(fw + bw - z[:, None])
        g = {"first": d_em[0].sum(0)}
        g_trans = np.zeros_like(trans)
        for t in range(1, steps):
            g_trans += np.exp(fw[t - 1][:, :, None] + trans + (em[t] + bw[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g_trans, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        np.add.at(g["first"], yt[0], -1)
        d_em[np.arange(steps)[:, None], ix, yt] -= 1
        g |= {"trans": np.where(self.bar < 0, 0, g_trans), "out": np.tensordot(both, d_em, ((0, 1), (0, 1))), "out_b": d_em.sum((0, 1))}
        d_both = d_em @ self.p["out"].T
        d_e = np.zeros_like(e)
        for d, kept, part in (("l", kl, d_both[:, :, :HIDDEN]), ("r", kr, d_both[:, :, HIDDEN:])):
            wx, wh = self.p[f"wx{d}"], self.p[f"wh{d}"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.p[f"b{d}"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, zt, (h0, c0), tc in reversed(kept):
                i, f, o, u = (zt[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                gx += e[t].T @ dz
                gh += h0.T @ dz
                gb += dz.sum(0)
                d_e[t] += dz @ wx.T
                dh, dc = dz @ wh.T, dc * f
            g |= {f"wx{d}": gx, f"wh{d}": gh, f"b{d}": gb}
        ge = np.zeros_like(self.p["e"])
        np.add.at(ge, x.T.ravel(), d_e.reshape(-1, EMBED))
        g["e"] = ge
        return float((z - gold).mean()), {k: (v / n).astype(np.float32) for k, v in g.items()}

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi: (windows, steps) tags, and each character's margin of its tag's emission over O's."""
        em, _ = self.emissions(x)
        steps, n, _ = em.shape
        trans = self.p["trans"] + self.bar
        best, back = self.p["first"] + self.bar_first + em[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            all_ = best[:, :, None] + trans
            back[t] = all_.argmax(1)
            best = np.take_along_axis(all_, back[t][:, None, :].astype(np.int64), 1)[:, 0] + em[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        margin = np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]
        return tags.T, margin.T


def labelled_lines(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Generated lines of SPAN characters with tags: words, numbers that are nobody's data, and personal data."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[r.integers(len(xs))]
    num = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    syl = "an be chi de er fo gu ha in jo ka li mo ne ou pa que ra st ti un ve wh xa yo zu é ü ß ñ tion ing the le der la".split()
    word = lambda: "".join(pick(syl) for _ in range(r.integers(1, 5)))
    name = lambda: f"{word()}{num(r.integers(0, 2))}".encode("ascii", "ignore").decode() or "host"
    host = lambda: f"{name()}-{name()}" if r.random() < 0.15 else name()
    tld = lambda: pick(["com", "org", "net", "de", "fr", "example.com", "co.uk"])

    def card() -> str:
        d = pick("3456") + num(r.integers(12, 16) - 0)
        d = next(d[:-1] + str(k) for k in range(10) if luhn(d[:-1] + str(k)))
        sep = pick(["", " ", "-", ".", " - ", "/"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        s = pick([" ", "-", ".", " "])
        a, b, c = num(3), num(3), num(4)
        return pick([f"+{r.integers(1, 99)} ({a}) {b}-{c}", f"+{r.integers(1, 99)}{s}{a}{s}{b}{s}{c}", f"({a}) {b}-{c}", f"({a}){s}{b}{s}{c}", f"{a}{s}{b}{s}{c}", f"00{r.integers(10, 99)}{s}{a}{s}{b}{s}{c}", f"0{num(2)}{s}{num(3)}{s}{num(2)}{s}{num(2)}", f"0{num(3)}/{num(3)}-{num(3)}", f"0{num(r.integers(2, 4))}{pick([' ', '/', '-'])}{num(r.integers(6, 9))}", f"{num(2)}{s}{num(3)}{s}{num(2)}{s}{num(2)}", f"{a}.{b}.{c}"])

    def ip() -> str:
        dot = pick([".", ".", "[.]", "(.)", " . "])
        return dot.join(str(x) for x in r.integers(0, 256, 4))

    def email() -> str:
        local = pick([host(), f"{host()}.{host()}", f"{host()}_{num(2)}", f"{host()}.{num(2)}"])
        at = pick(["@", "@", "@", " [at] ", "[at]", " (at) ", "(at)", " @ ", "@ ", "{at}", " {at} "])
        dot = "." if "@" in at else pick([".", ".", " [dot] ", " (dot) ", "[dot]", "(dot)"])
        return f"{local}{at}{host()}{dot}{tld().replace('.', dot)}"

    def other() -> str:
        y = r.integers(1950, 2030)
        return pick([f"{y}", f"{y}-{r.integers(1, 12):02d}-{r.integers(1, 28):02d}", f"{num(2)}/{num(2)}/{y}", f"{num(2)}:{num(2)}:{num(2)}", num(r.integers(1, 9)), f"{num(1)},{num(3)},{num(3)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(4)}", f"#{num(5)}", f"@{word()}", f"{num(12)}", f"{num(20)}", "".join(pick("0123456789abcdef") for _ in range(32)), f"${num(3)}.{num(2)}", f"{y}-{y + 3}", f"{num(2)} {num(2)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"http://{host()}.{tld()}/{num(4)}", "| - |", "*** ### $$$", f"at {word()}", f"({word()})", f"{num(2)}.{num(4)}, {num(2)}.{num(4)}", f"{num(3)}-{num(1)}, {num(1)}-{num(1)}", f"{y} {y + 2} {y + 9}"])

    make = (email, ip, card, phone)
    xs, ys = np.full((n, SPAN), 130), np.zeros((n, SPAN), np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < SPAN:
            u = r.random()
            if u < 0.22:
                k = r.integers(4)
                s = make[k]()
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
            else:
                s = other() if u < 0.42 else word().upper() if u < 0.47 else word()
                tags += [0] * len(s)
            gap = pick([" ", " ", " ", " ", ", ", ". ", "\n", "### ", "*** ", "&&& ", "!! ", " | ", ": "])
            text += s + gap
            tags += [0] * len(gap)
        shift = r.integers(0, min(40, len(text) - SPAN + 1))
        x, y = codes(text[shift : shift + SPAN]), np.array(tags[shift : shift + SPAN])
        if y[0] and y[0] % 2 == 0:
            y[0] -= 1
        xs[row, : len(x)], ys[row, : len(y)] = x, y
    return xs, ys


SPAN, LINES, EPOCHS, RATE = 72, 2560, 14, 0.012


@lru_cache(1)
def trained() -> Net:
    """The net after EPOCHS of Adam over LINES generated lines, half a minute of one core or more; once for each process."""
    net = Net()
    x, y = labelled_lines(LINES)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    r, t, size = np.random.default_rng(3), 0, 64
    for epoch in range(EPOCHS):
        order = r.permutation(len(x))
        for at in range(0, len(x), size):
            own = order[at : at + size]
            _, g = net.loss(x[own], y[own])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            t += 1
            rate = RATE * (1 - 0.85 * (epoch * len(x) + at) / (EPOCHS * len(x)))
            for k, a in g.items():
                a = a * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


_MARK = re.compile(r"@|[\[({] ?at ?[\])}]", re.I)


def windows(text: str) -> list[int]:
    """Starts of the windows that can hold a span which passes a check."""
    if len(text) <= WINDOW:
        starts = [0] if text else []
    else:
        starts = [*range(0, len(text) - WINDOW, STEP), len(text) - WINDOW]
    if not starts:
        return []
    x = codes(text)
    digits = np.concatenate([[0], np.cumsum((x >= 48) & (x <= 57))])
    marks = [m.start() for m in _MARK.finditer(text)]
    at = np.array(starts)
    end = np.minimum(at + WINDOW, len(text))
    ok = digits[end] - digits[at] >= 4
    if marks:
        ok |= np.searchsorted(marks, end) > np.searchsorted(marks, at)
    return at[ok].tolist()


def spans_of_tags(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and not (t == 2 + 2 * kind):
            out.append((kind, start, i))
            start = -1
        if t % 2 == 1:
            start, kind = i, (t - 1) // 2
    return out


def reconciled(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (weight, kind, start, end), the non-overlapping ones of greatest total weight."""
    spans = sorted(set(spans), key=lambda s: (s[3], s[2], s[1]))
    ends = [s[3] for s in spans]
    best, take = [0.0], []
    for i, (w, _, a, _) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], a, "right"))
        take.append((best[j] + w > best[i], j))
        best.append(max(best[i], best[j] + w))
    out, i = [], len(spans)
    while i:
        used, j = take[i - 1]
        if used:
            out.append(spans[i - 1][1:])
        i = j if used else i - 1
    return out[::-1]


def _decoded(texts: list[str], net: Net, places: list[tuple[int, int]], size: int):
    """Spans in the windows of `size` characters at places (text, start): (text, whole, weight, kind, start, end); a span that
    touches an edge within its text is not whole."""
    for at in range(0, len(places), BATCH):
        part = places[at : at + BATCH]
        x = np.full((len(part), size), 130)
        for row, (i, s) in enumerate(part):
            c = codes(texts[i][s : s + size])
            x[row, : len(c)] = c
        x = x[:, : max(8, int((x < 130).sum(1).max()))]
        tags, margin = net.decode(x)
        for row in np.flatnonzero(tags.any(1)):
            i, s = part[row]
            n = min(size, len(texts[i]) - s)
            for kind, a, b in spans_of_tags(tags[row][:n]):
                whole = (a > 0 or s == 0) and (b < n or s + n == len(texts[i]))
                yield i, whole, round(float(margin[row][a:b].sum()) + 0.01 * (b - a), 4), kind, s + a, s + b


def find(texts: list[str], net: Net) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    got: list[list] = [[] for _ in texts]
    cut: list[tuple[int, int, int]] = []
    for i, whole, weight, kind, a, b in _decoded(texts, net, [(i, s) for i, t in enumerate(texts) for s in windows(t)], WINDOW):
        if whole:
            got[i].append((weight, kind, a, b))
        else:
            cut.append((i, a, b))
    around = sorted({(i, max(0, (a + b - LONG) // 2)) for i, a, b in cut if not any(c <= a and b <= d for _, _, c, d in got[i])})
    for i, whole, weight, kind, a, b in _decoded(texts, net, around, LONG):
        if whole and b - a > WINDOW - STEP:  # shorter ones were whole in some window
            got[i].append((weight, kind, a, b))
    out = []
    for text, own, more in zip(texts, base, got, strict=True):
        taken = np.zeros(len(text) + 1, bool) if more else None
        for _, a, b in own if more else ():
            taken[a:b] = True
        ok = []
        for w, kind, a, b in more:
            while a < b and not (text[a].isalnum() or text[a] in "(+"):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            around = text[a - 1 : a] + " " + text[b : b + 1]
            if w > 0 and b > a and not taken[a:b].any() and not any(c.isalnum() for c in around) and passes(kind, text[a:b]):
                ok.append((w, kind, a, b))
        out.append((own, reconciled(ok)))
    return out


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _report(net: Net):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [(x or b"").decode(errors="replace") for x in batch.column(1).to_pylist()]
                cols: list[list] = [[] for _ in range(7)]
                for base, more in find(texts, net):
                    both = [*base, *more]
                    row = [sum(s[0] == k for s in base) for k in range(4)] + [hashlib.sha256(_written(base).encode()).hexdigest(), _written(both), len(both)]
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone (of base), base_sha256, spans and n_spans (base and
    added); one row each. An empty table gives an empty one; extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    docs = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(lean(lambda b: _report(shared.value)(b)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list) -> str:
    """The text with each span, and overlapping ones together, as [EMAIL] and so on (the first one's kind)."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked and n_chars, if there is one, counted anew. A null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    text_at = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(text_at).to_pylist()
                new = [None if t is None else masked(t, base + more) for t, (base, more) in zip(texts, find([t or "" for t in texts], shared.value), strict=True)]
                yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(new, batch.schema.field(text_at).type))

    out = same_columns(frugal(docs), lean(run))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
