"""Personal data: a character BiLSTM with CRF transitions beside exact patterns.

Patterns give the base spans (email, ip, card, phone), which always stay. A character-level bidirectional LSTM with a
linear-chain CRF, written in numpy and trained on windows that the patterns have labelled, adds spans of the same
kinds that no pattern matches: other separators, bracketed or spelt-out signs, phone numbers without a plus. It learns
these from rewrites of the patterns' spans in their own surroundings, beside decoys (dates, times, short numbers) that
are no personal data. Texts are cut into overlapping windows; the windows are decoded on their own, each position takes
the tag from the window in which it lies farthest from an edge, and spans are put together over the whole text. An
added span must be sure (mean marginal; the bound is set on training documents that the network has not seen), be sound
for its kind, and overlap no base span.

Windows without a digit, an @ or a spelt-out sign (SPELT) do not run and take no part in the reconciliation.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)  # 0: outside
WINDOW, STRIDE = 128, 64
HIDDEN = 16
#: Documents whose windows the network is trained on, at most, and windows of one document.
TRAIN_DOCS = 1000
TRAIN_PER_DOC = 4
#: Batches of windows that the network is trained on, and the rate of the first.
STEPS, RATE = 600, 0.03
#: Rewrites and decoys of one document that the network is trained on, each.
REWRITES = 4
#: One training document of so many is kept back to set the bound on the mean marginal of added spans: the lowest of
#: SURE at which the added spans there reach PRECISION, else the highest.
KEPT_BACK = 5
SURE = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
PRECISION = 0.98
#: Code points beyond which nothing is an address.
LONGEST = 400
#: Windows that go through the network together, at least where a batch has as many.
TOGETHER = 2048

LOCAL = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: after it the next character is no digit.
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9]([\x20().0-9-]+)")
TRIGGER = re.compile(r"[0-9@]")
SPELT = re.compile(r"[\[(]\s?at\s?[\])]|\bdot\b|\bat\s[A-Za-z0-9-]+\.[A-Za-z]")
# An address with its spelt-out or bracketed signs read as signs.
AT_SIGN = re.compile(r"\s?[\[(]\s?(?:at|@)\s?[\])]\s?|\s?@\s?|\sat\s")
DOT_SIGN = re.compile(r"\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?|\sdot\s|\s\.\s")
ADDRESS = re.compile(r"[\w.%+-]{2,}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Every @ with a local part before it and a domain behind, each in time linear in its surroundings."""
    found, free, last = [], 0, -1
    at = text.find("@")
    while at >= 0:
        before = text[max(free, last + 1) : at]
        local = len(before) - len(before.rstrip(LOCAL))
        match = DOMAIN.match(text, at + 1) if local else None
        last = at
        if match:
            found.append((at - local, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while match := PLUS.search(text, at):
        body = match.group(1).rstrip(" ().-")
        if len(body) < 2:
            at = match.start() + 1
            continue
        at = match.start() + 2 + len(body)
        if 9 <= len(_only_digits(text[match.start() : at])) <= 15:
            found.append((match.start(), at))
    return found


def _is_quad(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    if len(text) > 40:  # no 19 digits are that long
        return False
    digits = _only_digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind and start; offsets in code points."""
    if not TRIGGER.search(text):
        return []
    kinds = (
        _emails(text),
        [m.span() for m in QUAD.finditer(text) if _is_quad(m.group())],
        [m.span() for m in DIGITS.finditer(text) if _is_card(m.group())],
        _phones(text),
    )
    return [(k, a, b) for k, spans in enumerate(kinds) for a, b in spans]


def sound(kind: int, text: str) -> bool:
    """Whether a span that the network found can be of its kind at all."""
    digits = _only_digits(text)
    if kind == 0:
        return len(text) <= LONGEST and bool(ADDRESS.fullmatch(DOT_SIGN.sub(".", AT_SIGN.sub("@", text))))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and len(text) <= 2 * len(digits) and luhn(digits)
    return 9 <= len(digits) <= 15 and len(text) <= 2 * len(digits)


def rewritten(kind: int, text: str, rng: random.Random) -> str:
    """Another form of a span: the same address or number, with other separators or signs."""
    groups = re.findall(r"[0-9]+", text)
    if kind == 0:
        name, _, host = text.rpartition("@")
        at = rng.choice((" at ", " (at) ", "[at]", " [at] ", "(at)", " @ ", "[@]"))
        return name + at + host.replace(".", rng.choice((" dot ", "[dot]", " (dot) ", ".", "[.]", ".")))
    if kind == 1:
        return rng.choice(("[.]", "(.)", " . ", " dot ", "[dot]")).join(groups)
    if kind == 2:
        digits = "".join(groups)
        return rng.choice((".", "/", "_", " - ", "  ", ":")).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if len(groups) < 3:
        digits = "".join(groups)
        groups = [digits[:-7], digits[-7:-4], digits[-4:]]
    land, area, *rest = groups
    form = rng.randrange(4)
    if form == 0:
        return f"({area}) {'-'.join(rest)}"
    sign = rng.choice("-./ ")
    if form == 1:
        return sign.join((area, *rest))
    if form == 2:
        return sign.join((land, area, *rest))
    return f"+{land} ({area}) {'/'.join(rest)}" if rng.random() < 0.5 else "+" + "/".join((land, area, *rest))


def decoy(rng: random.Random) -> str:
    """A date, time, range, price, short list or turn of phrase that is no personal data."""
    n = lambda most: rng.randrange(1, most)
    return rng.choice((
        f"{n(29):02}/{n(13):02}/{1950 + n(80)}", f"{1950 + n(80)}-{n(13):02}-{n(29):02}", f"{n(24):02}:{n(60):02}:{n(60):02}",
        f"{n(400)}-{n(400)}", f"{n(999)}.{n(99):02}", f"{n(99)}, {n(99)}, {n(99)}, {n(99)}", f"{n(10)}.{n(20)}.{n(20)}", f"({n(2000)})",
        f"{n(10**6)}", f"{n(999)} {n(999):03}", f"at {n(24)}:{n(60):02}", f"a dot at {n(50)}.{n(50)}", f"{n(99)} dot {n(99)}", f"[{n(99)}]",
    ))


# Classes of characters that the network sees; digits, letters by case, each sign and each letter of "at" and "dot" of
# its own, the rest by kind.
SIGNS = " \n\t@.+-_%()[]/:,;='\"|#atdo"
PAD, DIGIT, SMALL, LARGE, WIDE, OTHER = range(6)
CLASSES = 6 + len(SIGNS)
_TABLE = np.full(128, OTHER, np.uint8)
_TABLE[0x30:0x3A], _TABLE[0x61:0x7B], _TABLE[0x41:0x5B] = DIGIT, SMALL, LARGE
for _k, _c in enumerate(SIGNS):
    _TABLE[ord(_c)] = 6 + _k


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], WIDE).astype(np.uint8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """BiLSTM weights (index 0 forwards, 1 backwards) and CRF scores."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    wo: np.ndarray
    bo: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    sure: float = SURE[-3]

    @staticmethod
    def fresh(hidden: int = HIDDEN, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        return Tagger(
            [f(CLASSES, 4 * hidden), f(CLASSES, 4 * hidden)], [f(hidden, 4 * hidden), f(hidden, 4 * hidden)],
            f(2 * hidden, TAGS), zeros(TAGS), zeros(TAGS, TAGS), zeros(TAGS),
        )

    def arrays(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, self.wo, self.bo, self.moves, self.first]

    def _run(self, x: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction for classes x (windows, length); padding keeps the state at zero."""
        wx, wh = self.wx[way], self.wh[way]
        n, length = x.shape
        size = wh.shape[0]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out = np.zeros((length, n, size), np.float32)
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            z = wx[x[:, t]] + h @ wh
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            real = (x[:, t] != PAD)[:, None]
            before = (h, c)
            c = np.where(real, f * c + i * g, 0)
            s = np.tanh(c)
            h = np.where(real, o * s, 0)
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, s, *before, real))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (length, windows, tags)."""
        both = np.concatenate([self._run(x, 0), self._run(x, 1)], axis=2)
        return both @ self.wo + self.bo

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags (windows, length)."""
        length, n, _ = scores.shape
        best = scores[0] + self.first
        back = np.zeros((length, n, TAGS), np.int8)
        for t in range(1, length):
            total = best[:, :, None] + self.moves
            back[t] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[t]
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def marginals(self, scores: np.ndarray, joint: bool = False):
        """Tag probabilities (length, windows, tags); with ``joint`` also the summed transition probabilities."""
        length, n, _ = scores.shape
        a, b = np.zeros_like(scores), np.zeros_like(scores)
        a[0] = scores[0] + self.first
        for t in range(1, length):
            a[t] = _logsum(a[t - 1][:, :, None] + self.moves, 1) + scores[t]
        for t in range(length - 2, -1, -1):
            b[t] = _logsum(self.moves[None] + (b[t + 1] + scores[t + 1])[:, None, :], 2)
        whole = _logsum(a[-1], 1)
        p = np.exp(a + b - whole[None, :, None])
        if not joint:
            return p
        moves = np.zeros((TAGS, TAGS), np.float32)
        for t in range(length - 1):
            moves += np.exp(a[t][:, :, None] + self.moves + (b[t + 1] + scores[t + 1])[:, None, :] - whole[:, None, None]).sum(axis=0)
        return p, moves

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Gradient of the negative log-likelihood, averaged over windows; arrays as in arrays()."""
        n, length = x.shape
        kept: list[list] = [[], []]
        states = [self._run(x, way, kept[way]) for way in (0, 1)]
        both = np.concatenate(states, axis=2)
        scores = both @ self.wo + self.bo
        d, d_moves = self.marginals(scores, joint=True)
        d_first = d[0].sum(axis=0)
        rows = np.arange(n)
        for t in range(length):
            d[t, rows, tags[:, t]] -= 1
        d_first = d_first - np.bincount(tags[:, 0], minlength=TAGS)
        np.add.at(d_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        size = self.wh[0].shape[0]
        d_wo = np.einsum("tnh,tnk->hk", both, d)
        d_both = d @ self.wo.T
        d_wx, d_wh = [], []
        one_hot = (x.T.reshape(-1, 1) == np.arange(CLASSES)).astype(np.float32)
        for way in (0, 1):
            steps, gh = np.empty((length, n, 4 * size), np.float32), np.zeros_like(self.wh[way])
            dh_next, dc_next = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
            for t, i, f, o, g, s, h0, c0, real in reversed(kept[way]):
                dh = np.where(real, d_both[t][:, way * size : (way + 1) * size] + dh_next, 0)
                dc = np.where(real, dc_next, 0) + dh * o * (1 - s * s)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                steps[t] = dz
                gh += h0.T @ dz
                dh_next, dc_next = dz @ self.wh[way].T, dc * f
            d_wx.append(one_hot.T @ steps.reshape(-1, 4 * size))
            d_wh.append(gh)
        return [g / n for g in (*d_wx, *d_wh, d_wo, d.sum(axis=(0, 1)), d_moves, d_first)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(x: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = RATE) -> Tagger | None:
    """Adam on windows of classes and tags, at a rate that falls to zero over the steps; without any labelled window
    there is no tagger."""
    if not len(x) or not tags.any():
        return None
    tagger = Tagger.fresh()
    rng = np.random.default_rng(5)
    first = [np.zeros_like(a) for a in tagger.arrays()]
    second = [np.zeros_like(a) for a in tagger.arrays()]
    order = np.empty(0, int)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.r_[order, rng.permutation(len(x))]
        part, order = order[:batch], order[batch:]
        for a, g, m, v in zip(tagger.arrays(), tagger.gradient(x[part], tags[part]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tagger


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, classes) of the overlapping windows that hold a digit, an @ or the beginning of a spelt-out sign; the
    last ones are padded."""
    codes = classes_of(text)
    starts = np.arange(0, max(1, len(codes) - (WINDOW - STRIDE)), STRIDE)
    marked = (codes == DIGIT) | (codes == _TABLE[ord("@")])
    marked[[m.start() for m in SPELT.finditer(text)]] = True
    hot = np.r_[0, np.cumsum(marked)]
    ends = np.minimum(starts + WINDOW, len(codes))
    starts = starts[hot[ends] > hot[starts]]
    padded = np.concatenate([codes, np.zeros(WINDOW, np.uint8)])
    return starts, padded[starts[:, None] + np.arange(WINDOW)]


def reconciled(length: int, starts: np.ndarray, tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean marginal) over the whole text: each position has the tag of the window in which it is
    farthest from an edge (the earlier of two)."""
    at = (starts[:, None] + np.arange(WINDOW)).ravel()
    edge = np.tile(np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]), len(starts))
    edge = np.where(np.repeat(starts == 0, WINDOW) & (at < WINDOW // 2), WINDOW, edge)  # the text's own start is no edge
    inside = at < length
    at, edge = at[inside], edge[inside]
    flat_tags, flat_sure = tags.ravel()[inside], sure.ravel()[inside]
    order = np.lexsort((-edge, at))
    at, flat_tags, flat_sure = at[order], flat_tags[order], flat_sure[order]
    keep = np.r_[True, at[1:] != at[:-1]] if len(at) else np.empty(0, bool)
    at, flat_tags, flat_sure = at[keep], flat_tags[keep], flat_sure[keep]
    tagged = flat_tags > 0
    at, flat_tags, flat_sure = at[tagged], flat_tags[tagged], flat_sure[tagged]
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(flat_tags) != 0)])
    ends = np.r_[cut[1:], len(at)]
    return [
        (int(flat_tags[a]) - 1, int(at[a]), int(at[b - 1]) + 1, float(flat_sure[a:b].mean())) for a, b in zip(cut, ends, strict=True)
    ]


def added_spans(
    text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float]], least: float
) -> list[tuple[int, int, int]]:
    """The network's spans that are sure, sound and apart from base spans, without white space and stops around them."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, a, b, p in found:
        inner = text[a:b]
        a += len(inner) - len(inner.lstrip(" \n\t.,;:\"'"))
        b -= len(inner) - len(inner.rstrip(" \n\t.,;:\"'"))
        if p >= least and a < b and sound(kind, text[a:b]) and all(e <= a or s >= b for s, e in taken):
            out.append((kind, a, b))
    return out


def shapes(text: str) -> list[tuple[int, int, int]]:
    """What the network learns to see: base spans, and numbers that fail a card's check digit alone, which is for
    ``sound`` to tell."""
    base = base_spans(text)
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    runs = [m.span() for m in DIGITS.finditer(text) if m.end() - m.start() <= 40]
    return base + [(2, a, b) for a, b in runs if 13 <= len(_only_digits(text[a:b])) <= 19 and not taken[a:b].any()]


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a text, with a window's room behind it."""
    tags = np.zeros(len(text) + WINDOW, np.uint8)
    for kind, a, b in spans:
        tags[a:b] = kind + 1
    return tags


def altered(text: str, rng: random.Random, most: int = REWRITES) -> list[tuple[str, int, int, int]]:
    """(passage, kind, start, end) for at most ``most`` base spans of a text, drawn by chance: a passage of up to WINDOW
    code points in which the span has another form that no pattern matches; kind -1 and a decoy in its place after
    each."""
    base = base_spans(text)
    out = []
    for kind, a, b in rng.sample(base, min(most, len(base))):
        for k, form in ((kind, rewritten(kind, text[a:b], rng)), (-1, decoy(rng))):
            room = max(0, WINDOW - len(form))
            before = rng.randrange(room + 1)
            head, tail = text[max(0, a - before) : a], text[b : b + room - before]
            passage, at = head + form + tail, len(head)
            if k < 0 or all(e <= at or f >= at + len(form) for _, f, e in base_spans(passage)):
                out.append((passage, k, at, at + len(form)))
    return out


def _bound(tagger: Tagger, rows: list[tuple[str, int, int, int]]) -> float:
    """The lowest of SURE at which spans added to passages are right with PRECISION."""
    if not rows:
        return tagger.sure
    x = np.stack([np.r_[classes_of(t), np.zeros(WINDOW, np.uint8)][:WINDOW] for t, *_ in rows])
    tags, sure = _decode(tagger, x)
    for least in SURE:
        good = bad = 0
        for k, (t, kind, a, b) in enumerate(rows):
            spans = added_spans(t, base_spans(t), reconciled(len(t), np.array([0]), tags[k : k + 1], sure[k : k + 1]), least)
            good += (kind, a, b) in spans
            bad += len(set(spans) - {(kind, a, b)})
        if good and good >= PRECISION * (good + bad):
            return least
    return SURE[-1]


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS, steps: int = STEPS) -> Tagger | None:
    """Trains on windows of at most ``most`` documents (by a hash of the id and text) that hold a digit or an @:
    TRAIN_PER_DOC windows of each, labelled by the patterns, and REWRITES rewrites and decoys of its spans.

    The windows and passages (WINDOW code points each) come to the driver; repeated rows count once. One document of
    KEPT_BACK is not trained on; its rewrites and decoys set the tagger's bound ``sure``.
    """
    holding = documents.filter(F.col(text).rlike("[0-9@]")).select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("__h"), text)
    bound = holding.select("__h").orderBy("__h").limit(most).agg(F.max("__h")).first()[0]
    if bound is None:
        return None

    def make():
        def work(texts, _):
            rows, others = [], []
            for t in texts:
                t = t.decode()
                starts, x = windows_of(t)
                y = _labelled(t, shapes(t))[starts[:, None] + np.arange(WINDOW)]
                # Labelled windows first, then others, spread over the text.
                pick = np.argsort(~(y > 0).any(axis=1), kind="stable")
                pick = pick[np.unique(np.linspace(0, len(pick) - 1, TRAIN_PER_DOC).astype(int))]
                rows.append([x[k].tobytes() + y[k].tobytes() for k in pick])
                rng = random.Random(zlib.crc32(t.encode()))
                others.append([{"passage": p, "kind": k, "start": a, "end": b} for p, k, a, b in altered(t, rng)])
            return [pa.array(rows, pa.list_(pa.binary())), pa.array(others, passages)]

        return work

    passages = pa.list_(pa.struct([("passage", pa.string()), ("kind", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    fields = [
        T.StructField("rows", T.ArrayType(T.BinaryType())),
        T.StructField("others", T.ArrayType(T.StructType.fromDDL("passage string, kind bigint, start bigint, end bigint"))),
    ]
    made = map_texts(holding.filter(F.col("__h") <= bound), make, fields, text).select("record.__h", "rows", "others").dropDuplicates(["__h"])
    labelled, kept, trained = [], [], []
    for r in sorted(made.toLocalIterator(), key=lambda r: r["__h"]):
        mine = [tuple(o) for o in r["others"]]
        if r["__h"] % KEPT_BACK == 0:
            kept += mine
            continue
        labelled += map(bytes, r["rows"])
        trained += mine
    both = np.frombuffer(b"".join(labelled), np.uint8).reshape(-1, 2 * WINDOW)
    x, y = [both[:, :WINDOW]], [both[:, WINDOW:]]
    for t, kind, a, b in trained:
        spans = [s for s in shapes(t) if s[2] <= a or s[1] >= b] + ([(kind, a, b)] if kind >= 0 else [])
        x.append(np.r_[classes_of(t), np.zeros(WINDOW, np.uint8)][None, :WINDOW])
        y.append(_labelled(t, spans)[None, :WINDOW])
    tagger = train(np.concatenate(x), np.concatenate(y).astype(np.int64), steps)
    if tagger is not None:
        tagger.sure = _bound(tagger, kept)
    return tagger


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def find_personal_data(documents: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """(record, base, added) per document: lists of structs (kind, start, end), in code points, end exclusive.

    ``base`` has the patterns' spans by kind and start, ``added`` the network's. Null and empty texts have none;
    texts of any length are read whole, window by window. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def decoded(pending: list[tuple[int, str, list, np.ndarray, np.ndarray]], added: list) -> None:
        """Spans of several texts, whose windows go through the network together."""
        tags, sure = _decode(tagger, np.concatenate([p[4] for p in pending]))
        at = 0
        for k, t, spans, starts, x in pending:
            part = slice(at, at + len(x))
            added[k] = rows(sorted(added_spans(t, spans, reconciled(len(t), starts, tags[part], sure[part]), tagger.sure)))
            at += len(x)

    def make():
        def work(texts, _):
            base, added, pending, waiting = [], [[] for _ in texts], [], 0
            for k, raw in enumerate(texts):
                t = raw.decode()
                spans = base_spans(t)
                base.append(rows(spans))
                if tagger is not None and (TRIGGER.search(t) or SPELT.search(t)):
                    pending.append((k, t, spans, *windows_of(t)))
                    waiting += len(pending[-1][3])
                if waiting >= TOGETHER:
                    decoded(pending, added)
                    pending, waiting = [], 0
            if pending:
                decoded(pending, added)
            return [pa.array(base, kind), pa.array(added, kind)]

        return work

    return map_texts(documents, make, [T.StructField("base", SPANS), T.StructField("added", SPANS)], text)


def _decode(tagger: Tagger, x: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Tags of windows and their marginal probabilities."""
    tags, sure = np.zeros(x.shape, np.int8), np.zeros(x.shape, np.float32)
    for at in range(0, len(x), block):
        scores = tagger.emissions(x[at : at + block])
        best = tagger.viterbi(scores)
        tags[at : at + block] = best
        some = np.flatnonzero((best > 0).any(axis=1))
        if len(some):
            p = tagger.marginals(scores[:, some])
            sure[at + some] = np.take_along_axis(p, best[some].T[:, :, None].astype(np.int64), axis=2)[:, :, 0].T
    return tags, sure
