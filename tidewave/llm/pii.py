"""Operator 1: personal data by exact patterns and by a character-level bidirectional LSTM with CRF transitions.

The base spans follow fixed patterns of e-mail addresses, IP addresses, card and phone numbers over whole texts, in
time linear in the text. The network reads whole words around every digit, @ and spelled sign of a text (at or AT, bare
or in brackets, before a label and a dot that touches letters or is spelled; the word dot): an added span must pass its
kind's check, which asks for digits, an @ or such an at, so no span is lost for not being read. Each such region is cut into overlapping windows, the emissions of all windows that cover a character are averaged with weights that fall towards window edges, and one
Viterbi pass over the whole region reconciles the windows. What it finds beside the base spans is added with the kind
followed by ``_like`` if it passes the kind's check (digits, Luhn, ranges). Base spans are never dropped or changed.

The network is trained in numpy on windows of at most ``train_docs`` different texts (smallest hashes): their base spans are
the labels, and seeded variants of them (other separators, spelled signs, addresses without digits), harmless numbers
and places around spelled signs are put in as well.

Defined results: null texts are empty; a text without spans has counts of 0 and empty ``spans``; positions are code
points, end exclusive; equal texts give equal spans; extra columns are ignored; with nothing to train on only base
spans are found.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import give_back, sampled, table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPACE = re.compile(r"[ \n\t\r]")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_OR_AT = re.compile(r"[0-9@]")
SPELLED = re.compile(r"\b(?:at|AT|dot)\b")
# a spelled sign counts where a host name follows it: a label, then a dot that touches letters or is spelled itself
SPELLED_AT = r"\b(?:at|AT)\b[\s)\]]{1,3}[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9]|\s{0,3}[(\[]?\s?dot\b)"
TRIGGER = re.compile(rf"[0-9@]|{SPELLED_AT}|\bdot\b")
HOST_DOT = re.compile(r"[A-Za-z0-9-](?:\.|\s*[(\[]?\s*\bdot\b\s*[)\]]?\s*)[A-Za-z]")
AT_SIGN = re.compile(rf"@|{SPELLED_AT}")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def ascii_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free:
            start = at
            while start > free and LOCAL_BACK.fullmatch(text, start - 1, start):
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                free = m.end()
            else:
                free = max(free, start)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    if not DIGIT_OR_AT.search(text):
        return []
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := ascii_digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(ascii_digits(m[0])) <= 15]


# The network

WINDOW, STRIDE, MARGIN = 56, 28, 40
HIDDEN, EMBED = 20, 12
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
N_CODES = 100
FORBIDDEN = np.zeros((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    FORBIDDEN[:, 2 + 2 * _k] = True
    FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False
BAN = -1e4


def char_codes(text: str) -> np.ndarray:
    """Small numbers for characters; all digits share one, and all capitals."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where((points >= 48) & (points <= 57), 48, np.where((points >= 65) & (points <= 90), 65, points))
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 96, np.where(points < 0x250, 97, 98)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Outputs over time-major x (T, n, E) and what the backward pass needs."""
    T, n, _ = x.shape
    H = u.shape[0]
    z = x @ w + b
    h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
    out, kept = np.empty((T, n, H), np.float32), []
    for t in range(T):
        a = z[t] + h @ u
        s = sigmoid(a[:, : 3 * H])
        i, f, o, g = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :], np.tanh(a[:, 3 * H :])
        c0, h0 = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, g, c0, h0, tc))
    return out, kept


def _lstm_back(d: np.ndarray, kept: list, x: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    T, n, H = d.shape
    dz = np.empty((T, n, 4 * H), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
    for t in range(T - 1, -1, -1):
        i, f, o, g, c0, h0, tc = kept[t]
        dh = dh + d[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += h0.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return dz @ w.T, np.tensordot(x, dz, ([0, 1], [0, 1])), du, dz.sum(axis=(0, 1))


@dataclass(frozen=True)
class Tagger:
    p: dict[str, np.ndarray]

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(T, n, TAGS) from codes (n, T)."""
        p = self.p
        x = p["embed"][codes.T]
        ahead, k1 = _lstm(x, p["w1"], p["u1"], p["b1"])
        back, k2 = _lstm(x[::-1], p["w2"], p["u2"], p["b2"])
        h = np.concatenate([ahead, back[::-1]], axis=2)
        return h @ p["v"] + p["c"], (x, k1, k2, h)

    def links(self) -> np.ndarray:
        return np.where(FORBIDDEN, BAN, self.p["links"])

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags (n, T) and its gradient."""
        e, (x, k1, k2, h) = self.emissions(codes)
        T, n, K = e.shape
        start = np.where(np.arange(K) % 2 == 0, BAN, 0.0)
        start[0] = 0
        top = e.max(axis=2, keepdims=True)
        local = np.exp((e - top).astype(np.float64))
        links = np.exp(self.links().astype(np.float64))
        a, b, logz = np.empty((T, n, K)), np.ones((T, n, K)), top.sum(axis=(0, 2)).astype(np.float64)
        for t in range(T):
            v = local[0] * np.exp(start) if t == 0 else (a[t - 1] @ links) * local[t]
            s = v.sum(axis=1, keepdims=True)
            a[t] = v / s
            logz += np.log(s[:, 0])
        pairs = np.zeros((K, K))
        for t in range(T - 2, -1, -1):
            v = local[t + 1] * b[t + 1]
            m = a[t].T @ (v / np.einsum("nk,kl,nl->n", a[t], links, v)[:, None])
            pairs += m * links
            v = v @ links.T
            b[t] = v / v.sum(axis=1, keepdims=True)
        q = a * b
        q /= q.sum(axis=2, keepdims=True)
        rows = np.arange(n)
        gold = sum(e[t, rows, tags[:, t]] for t in range(T)) + self.links()[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        seen = np.zeros((K, K))
        np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        de = q
        de[np.arange(T)[:, None], rows[None, :], tags.T] -= 1
        de = (de / n).astype(np.float32)
        p, H = self.p, HIDDEN
        g = {"links": np.where(FORBIDDEN, 0, (pairs - seen) / n).astype(np.float32), "v": np.tensordot(h, de, ([0, 1], [0, 1])), "c": de.sum(axis=(0, 1))}
        dh = de @ p["v"].T
        dx, g["w1"], g["u1"], g["b1"] = _lstm_back(dh[:, :, :H], k1, x, p["w1"], p["u1"])
        dy, g["w2"], g["u2"], g["b2"] = _lstm_back(dh[::-1, :, H:], k2, x[::-1], p["w2"], p["u2"])
        one = np.zeros((T * n, N_CODES), np.float32)
        one[np.arange(T * n), codes.T.ravel()] = 1
        g["embed"] = one.T @ (dx + dy[::-1]).reshape(T * n, -1)
        return float((logz - gold).mean()), g

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence of emissions (T, TAGS)."""
        links = self.links()
        best = e[0] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), BAN, 0)
        back = np.empty((len(e), TAGS), np.int8)
        for t in range(1, len(e)):
            v = best[:, None] + links
            back[t] = v.argmax(axis=0)
            best = v.max(axis=0) + e[t]
        tags = np.empty(len(e), np.int8)
        tags[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def spans(self, many: list[str]) -> list[list[Span]]:
        """What the network alone finds in each text."""
        out: list[list[Span]] = [[] for _ in many]
        regions = [(row, a, b) for row, text in enumerate(many) for a, b in regions_of(text)]
        for at in range(0, len(regions), 256):
            group, codes, places = regions[at : at + 256], [], []
            for k, (row, a, b) in enumerate(group):
                c = char_codes(many[row][a:b])
                for s in range(0, max(1, len(c) - WINDOW + STRIDE), STRIDE):
                    piece = c[s : s + WINDOW]
                    codes.append(np.concatenate([piece, np.full(WINDOW - len(piece), 99)]))
                    places.append((k, s, len(piece)))
            sums = [np.zeros((b - a, TAGS)) for _, a, b in group]
            shares = [np.zeros((b - a, 1)) for _, a, b in group]
            for j in range(0, len(codes), 512):
                e, _ = self.emissions(np.array(codes[j : j + 512]))
                for i, (k, s, n) in enumerate(places[j : j + 512]):
                    weight = np.minimum(np.arange(n) + 1, n - np.arange(n))[:, None].astype(np.float64)
                    sums[k][s : s + n] += e[:n, i] * weight
                    shares[k][s : s + n] += weight
            for (row, a, _), total, share in zip(group, sums, shares, strict=True):
                out[row] += [(k, s + a, t + a) for k, s, t in tag_spans(self.decode(total / share))]
        return out


def regions_of(text: str) -> list[tuple[int, int]]:
    """Places of whole words around digits, @ and spelled signs, joined where they meet."""
    near: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if near and a <= near[-1][1]:
            near[-1] = near[-1][0], b
        else:
            near.append((a, b))
    out: list[tuple[int, int]] = []
    for (a, b), (after, _) in zip(near, [*near[1:], (len(text), len(text))], strict=False):
        a = max(text.rfind(c, out[-1][1] if out else 0, a) + 1 for c in " \n\t\r") or (out[-1][1] if out else 0)
        m = SPACE.search(text, b, after)
        b = m.start() if m else after
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def tag_spans(tags: np.ndarray) -> list[Span]:
    out, at = [], 0
    while at < len(tags):
        end = at + 1
        if tags[at]:
            inside = tags[at] + 1 if tags[at] % 2 else tags[at]
            while end < len(tags) and tags[end] == inside:
                end += 1
            out.append((KINDS[(tags[at] - 1) // 2], at, end))
        at = end
    return out


def plausible(kind: str, text: str) -> bool:
    """The check that a span found by the network alone must pass."""
    digits = ascii_digits(text)
    if kind == "email":
        return bool(AT_SIGN.search(text) and HOST_DOT.search(text))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def find_all(tagger: Tagger | None, many: list[str]) -> list[list[Span]]:
    """Base spans, then added ones, of each text."""
    base = [base_spans(t) for t in many]
    if tagger is None:
        return base
    out = []
    for text, own, found in zip(many, base, tagger.spans(many), strict=True):
        more = []
        for kind, a, b in found:
            while a < b and not text[a].isalnum() and text[a] not in "+([":
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if TRIGGER.search(text, a, b) and not any(a < t and s < b for _, s, t in own) and plausible(kind, text[a:b]):
                more.append((f"{kind}_like", a, b))
        out.append(own + sorted(more, key=lambda x: ([f"{k}_like" for k in KINDS].index(x[0]), x[1])))
    return out


# Training


def address(draw: random.Random) -> str:
    """An e-mail address without digits."""
    word = lambda: "".join(draw.choice("bcdfghjklmnprstvwz") + draw.choice("aeiouy") + draw.choice(["", "", "n", "r", "s", "l", "th"]) for _ in range(draw.randint(1, 4)))
    name = draw.choice([".", "_", "-", "."]).join(word() for _ in range(draw.choice([1, 2, 2, 3])))
    host = ".".join([draw.choice([word(), "mail", f"{word()}-{word()}"]) for _ in range(draw.choice([1, 1, 2]))] + [draw.choice(["com", "org", "net", "de", "fr", "io", "co.uk", "edu", "info"])])
    return f"{name.title() if draw.random() < 0.2 else name}@{host}"


def variants(kind: str, text: str, draw: random.Random) -> str:
    """The same kind of thing in another spelling."""
    if kind == "email":
        name, _, host = text.partition("@")
        sign = draw.choice([" at ", " (at) ", "[at]", " [at] ", " AT ", " at ", " @ ", "@"])
        return name + sign + host.replace(".", draw.choice([".", " dot ", " [dot] ", " dot ", " (dot) ", "."]))
    if kind == "ip":
        return text.replace(".", draw.choice([" . ", "[.]", "(.)", " dot "]))
    if kind == "card":
        d = ascii_digits(text)
        return draw.choice([".", " - ", "/", " ", "_"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = ascii_digits(text)
    return draw.choice([f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"00{d[:-10]} {d[-10:-7]} {d[-7:-4]} {d[-4:]}", f"+{d[:-10]}/{d[-10:-7]}/{d[-7:]}"])


def harmless(draw: random.Random) -> str:
    n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    hexa = "".join(draw.choice("0123456789abcdef") for _ in range(draw.randint(12, 40)))
    return draw.choice([f"version {n(1)}.{n(1)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}", n(4), n(draw.randint(1, 7)), f"{n(2)}.{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"${n(3)},{n(3)}.{n(2)}", f"id {n(draw.randint(5, 7))}", f"key={hexa}", f'token = "{hexa}"', f"{n(1)},{n(3)},{n(3)}", f"@{n(2)}", f"no. {n(3)}/{n(2)}", f"{n(2)} % of {n(3)}", hexa, f"@user{n(2)}"])


def examples(many: list[str], seed: int = 1, most: int = 4800, spans: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags around labelled spans, their variants and harmless numbers.

    Bounds of the training set: ``most`` windows in all (a seeded choice), and of each snippet its first ``spans`` spans.
    """
    draw, codes, tags = random.Random(seed), [], []

    def add(text: str, spans: list[Span], a: int) -> None:
        a = max(0, min(a, len(text) - 1))
        c, t = char_codes(text[a : a + WINDOW]), np.zeros(WINDOW, np.int64)
        for kind, s, e in spans:
            k = 1 + 2 * KINDS.index(kind)
            for i in range(max(s, a), min(e, a + WINDOW)):
                t[i - a] = k + (i > s and i > a)
        codes.append(np.concatenate([c, np.full(WINDOW - len(c), 99)]))
        tags.append(t)

    for text in many:
        if not text:
            continue
        labels = base_spans(text)
        overlap = any(a < t and s < b for i, (_, a, b) in enumerate(labels) for _, s, t in labels[i + 1 :])
        for kind, a, b in labels[:spans]:
            if overlap:
                break
            add(text, labels, a - draw.randint(5, WINDOW - 5))
            for _ in range(2):
                other = variants(kind, text[a:b], draw)
                near = text[max(0, a - WINDOW) : a]
                add(near + other + text[b : b + WINDOW], [(kind, len(near), len(near) + len(other))], len(near) - draw.randint(2, WINDOW - 10))
        at = draw.randint(0, len(text))
        near, rest, what = text[max(0, at - WINDOW) : at], text[at : at + WINDOW], harmless(draw)
        whole = near + " " + what + " " + rest
        if not base_spans(whole):
            add(whole, [], len(near) - draw.randint(0, WINDOW - 20))
        for _ in range(4):
            at = draw.randint(0, len(text))
            near, rest = text[max(0, at - WINDOW) : at], text[at : at + WINDOW]
            if base_spans(near + " " + rest):
                continue
            gap, other = draw.choice([" ", " ", ": ", " ("]), variants("email", address(draw), draw)
            whole = near + gap + other + draw.choice([" ", ", ", ". ", ") "]) + rest
            add(whole, [("email", len(near + gap), len(near + gap) + len(other))], len(near) - draw.randint(0, WINDOW - 10) + draw.choice([0, 0, 20]))
        if not overlap:
            for a, _ in regions_of(text)[:1]:
                add(text, labels, a + draw.randint(-10, 20))
            for m in list(SPELLED.finditer(text))[:2]:
                add(text, labels, m.start() - draw.randint(5, WINDOW - 5))
    order = list(range(len(codes)))
    draw.shuffle(order)
    order = order[:most]
    return np.array([codes[i] for i in order]).reshape(-1, WINDOW), np.array([tags[i] for i in order]).reshape(-1, WINDOW)


def fit(codes: np.ndarray, tags: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Tagger | None:
    if not len(codes) or not tags.any():
        return None
    r = np.random.default_rng(seed)
    H, E = HIDDEN, EMBED
    make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    bias = np.zeros(4 * H, np.float32)
    bias[H : 2 * H] = 1
    p = {"embed": make(N_CODES, E) * 3, "w1": make(E, 4 * H), "u1": make(H, 4 * H), "b1": bias, "w2": make(E, 4 * H), "u2": make(H, 4 * H), "b2": bias.copy(), "v": make(2 * H, TAGS), "c": np.zeros(TAGS, np.float32), "links": np.zeros((TAGS, TAGS), np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(codes) // batch)
    for _ in range(epochs):
        order = r.permutation(len(codes))
        for at in range(0, len(order), batch):
            step += 1
            _, g = Tagger(p).gradient(codes[order[at : at + batch]], tags[order[at : at + batch]])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1, 5 / (size + 1e-9)) * (1 - 0.95 * step / total)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Tagger(p)


def train(docs: DataFrame, train_docs: int = 600, snippet: int = 400) -> Tagger | None:
    """Fits on snippets of ``snippet`` characters around the first digit or @ of at most ``train_docs`` different texts."""
    text = F.col("text")
    place = F.regexp_instr(text, F.lit("[0-9@]"))
    near = docs.where(place > 0).select(F.md5(text).alias("k"), F.substring(text, F.greatest(F.lit(1), place - F.lit(snippet // 4)), F.lit(snippet)).alias("t"))
    rows = sorted(sampled(near, F.col("k"), train_docs).collect(), key=lambda r: (r["hash"], r["k"], r["t"]))
    return fit(*examples([r["t"] for r in rows]))


SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


def spans_column(tagger: Tagger | None, text: str = "text") -> F.Column:
    """All spans of a text column, base spans first."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(SPAN_TYPE)
    def found(column: pa.Array) -> pa.Array:
        out: list = []
        for at in range(0, len(column), 256):
            out += find_all(tagger, [x or "" for x in column.slice(at, 256).to_pylist()])
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in out], pa.list_(span))

    return found.asNondeterministic()(F.col(text).cast("string"))


def redact_column(tagger: Tagger | None, text: str = "text") -> F.Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        out: list = []
        for at in range(0, len(column), 256):
            many = column.slice(at, 256).to_pylist()
            for t, spans in zip(many, find_all(tagger, [x or "" for x in many]), strict=True):
                if t and spans:
                    parts, free = [], 0
                    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if a >= free:
                            parts += [t[free:a], f"[{kind.removesuffix('_like').upper()}]"]
                        free = max(free, b)
                    t = "".join([*parts, t[free:]])
                out.append(t)
        give_back()
        return pa.array(out, pa.string())

    return redacted.asNondeterministic()(F.col(text).cast("string"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", spans_column(train(docs)).alias("s"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["kind"].isin(*KINDS))
    of = lambda kind: lambda x: x == kind
    found = found.withColumn("kinds", F.col("s.kind"))
    return found.select("doc_id", *[F.size(F.filter("kinds", of(k))).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("s")).alias("spans"))
