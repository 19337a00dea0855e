"""Personal data by fixed patterns and a skip-chain conditional random field.

Four patterns give the base spans of a text. A conditional random field over its candidate tokens then finds what the
patterns miss. Candidates hold a digit or `@`, are the name before the `@` of an address found, or are runs of digit
groups with the digits of a card or phone found (of a phone also its last ones), whatever parts the groups. Neighbours
share a chain potential. Tokens that are repeated or similar, however far apart, share a skip potential: all tokens of a
key hang on a hub, a variable of its own, which is evidence too if one of them is a base span, so any number of
repetitions is reached in one step and gets one label; hubs of similar
keys are linked: numbers with the same last seven digits, card and phone numbers with one digit changed, an address and
its name. So the edges grow with the tokens. Base spans are evidence, and loopy belief propagation carries their labels
to the rest until the messages stand still (they are damped the more the longer it takes). A token is added if the
marginal of a kind reaches that kind's threshold.

The weights are trained by pseudo-likelihood, with base spans as labels and a Gaussian prior that holds linked tokens
together; a token without a kind that is linked to one with a kind is no example, since the patterns may have missed it.
Links are taught by mentions whose kind is known but hidden from the patterns: to a text with personal data are added a
phone's last seven digits, an address's name, a card with a digit changed, and numbers that look alike and belong to
none. One text in HELD is left out of the training; on these, each kind's threshold is the least that is right in
RIGHT of its additions.
Features leave out what the patterns hang on, as a leading plus, so other writings can be told. The training rows are a
bounded sample: the SAMPLE texts of least hash among those with 1 to MOST candidates.

Cases: null text is empty; a long run of digits or of address characters costs linear time; repeated rows are each
scanned; where a token could be added that overlaps a base span, the base span alone stays; without candidates there is
no span; a column named as the result is replaced, all others pass through; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batched, release

#: Order of kinds where spans start together; label 0 is "none". SURE: the threshold of a kind of which no text was held out.
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SURE, DAMP, HELD, RIGHT = 0.9, 0.3, 5, 0.95
#: Texts to train on, the most candidates that such a text has, hashed features.
SAMPLE, MOST, FEATURES = 4_000, 200, 4096
CHAIN, EQUAL, SIMILAR = 0, 1, 2
#: Prior means of the log potentials with which linked tokens hold the same kind; precisions of the priors of the weights, and of the potentials for each text of the sample.
CONSISTENT, PRECISION, FIRM = (0.0, 6.0, 5.0), 1.0, 0.1
LEAST_DIGITS = 7

# What the patterns are made of.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9.%+@()_-]*[0-9@][A-Za-z0-9.%+@()_-]*")
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_JOIN = re.compile(r"[\x20().-]{0,3}")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free, before = text.find("@"), 0, -1
    while at >= 0:
        piece = text[max(free, before + 1) : at]
        start = at - (len(piece) - len(piece.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        before, at = at, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end) of the patterns' spans, by start and kind."""
    out = [(a, 1, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 2, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 3, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 4, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of digits by their length, of letters and of other characters by one sign."""
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: f"{min(m.end() - m.start(), 20)}d", token))[:40]


def _written(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, digits) of runs of whole digit groups with all digits of a card or phone among the base spans, or with LEAST_DIGITS or more of a phone's last ones; runs do not overlap."""
    known = set()
    for a, label, b in base:
        if KINDS[label - 1] in ("card", "phone"):
            digits = "".join(_GROUP.findall(text[a:b]))
            known |= {digits[i:] for i in range(max(1, len(digits) - LEAST_DIGITS + 1) if KINDS[label - 1] == "phone" else 1)}
    if not known:
        return []
    sizes, taken = sorted({len(d) for d in known}, reverse=True), sorted((a, b) for a, label, b in base if KINDS[label - 1] in ("email", "ip"))
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text)]
    out, i, at = [], 0, 0
    while i < len(groups):
        # the digits from group i on, as far as a known number may reach, and the groups' ends among them
        digits, ends, j = "", {}, i
        while j < len(groups) and (j == i or _JOIN.fullmatch(text, groups[j - 1][1], groups[j][0])) and len(digits) + groups[j][1] - groups[j][0] <= sizes[0]:
            digits += text[groups[j][0] : groups[j][1]]
            ends[len(digits)] = j
            j += 1
        last = next((ends[n] for n in sizes if n in ends and digits[:n] in known), None)
        if last is None:
            i += 1
            continue
        start, end = groups[i][0], groups[last][1]
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append((start - (start > 0 and text[start - 1] == "+"), end, "".join(text[a:b] for a, b in groups[i : last + 1])))
        i = last + 1
    return out


def _locals(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """The names before the `@` of addresses among the base spans, of four characters or more."""
    return {n for n in (text[a:b].partition("@")[0].lower() for a, label, b in base if label == 1) if len(n) >= 4}


def _names(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the name before the `@` of an address among the base spans stands alone, without digits."""
    names = {n for n in _locals(text, base) if not _DIGIT.search(n)}
    return [m.span() for m in re.finditer(r"[A-Za-z._%+-]+", text) if m[0].lower().strip(".") in names and text[m.end() : m.end() + 1] != "@"] if names else []


def nodes(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int], list[str]]:
    """The candidate tokens' spans, their labels by the base spans (0: in none), and the keys by which tokens repeat ("": none)."""
    spans, labels, keys, i = [], [], [], 0
    found, w = _written(text, base), 0
    pieces = []
    for m in _TOKEN.finditer(text):
        # what of the token is in no run of groups
        at = m.start()
        while w < len(found) and found[w][0] < m.end():
            pieces.append((at, found[w][0], ""))
            pieces.append(found[w])
            at, w = found[w][1], w + 1
        if w and at < found[w - 1][1]:
            at = found[w - 1][1]
        pieces.append((at, m.end(), ""))
    if names := _names(text, base):
        pieces = sorted([*pieces, *((a, b, "name") for a, b in names)])
    called = _locals(text, base)
    base = sorted(base, key=lambda s: (s[0], -s[2]))
    for start, end, key in pieces:
        token = text[start:end] if key.isdigit() else text[start:end].strip(".()-_%")
        if not token or not (key or "@" in token or _DIGIT.search(token)) or spans and start < spans[-1][1]:
            continue
        start += text[start:end].find(token)
        end = start + len(token)
        while i < len(base) and base[i][2] <= start:
            i += 1
        label = base[i][1] if i < len(base) and base[i][0] < end else 0
        digits = "".join(c for c in token if c.isdigit())
        if not key or key == "name":
            key = token.lower() if key or "@" in token or token.count(".") == 3 or token.lower() in called else digits if len(digits) >= LEAST_DIGITS and len(digits) >= len(token) - 3 else ""
        spans.append((start, end))
        labels.append(label)
        keys.append(key)
    return spans, labels, keys


def _alike(key: str) -> list[tuple]:
    """What keys must have in common to be similar: the name of an address, the last digits, all digits but one."""
    if not key.isdigit():
        return [("name", key.partition("@")[0])]
    one = [("but", i, key[:i] + "*" + key[i + 1 :]) for i in range(len(key))] if 10 <= len(key) <= 19 else []  # as long as phones and cards are
    return [("end", key[-LEAST_DIGITS:]), *one]


def _edges(text: str, spans: list, keys: list[str]) -> list[tuple[int, int, int]]:
    """(a, b, kind): close neighbours, each token of a repeated key and the key's hub (numbered after the tokens), and one token or hub of each key with the first that is similar."""
    out, of = [], {}
    for i, (span, key) in enumerate(zip(spans, keys, strict=True)):
        if i and _JOIN.fullmatch(text, spans[i - 1][1], span[0]):
            out.append((i - 1, i, CHAIN))
        if key:
            of.setdefault(key, []).append(i)
    first, hub = {}, len(spans)
    for key, tokens in of.items():
        stands = tokens[0]
        if len(tokens) > 1:
            stands, hub = hub, hub + 1
            out += [(i, stands, EQUAL) for i in tokens]
        linked = set()
        for a in _alike(key):
            other = first.setdefault(a, stands)
            if other != stands and other not in linked:
                out.append((other, stands, SIMILAR))
                linked.add(other)
    return out


def _hubs(labels: list[int], edges: list[tuple[int, int, int]]) -> list[int]:
    """The labels of the hubs: the kind that a base span among its tokens shows, else 0."""
    out: dict[int, int] = {}
    for i, hub, k in edges:
        if k == EQUAL:
            out[hub] = out.get(hub) or labels[i]
    return [out[h] for h in sorted(out)]


def features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a token: its shape and number of digits, whether check digits or parts fit, the word before. Always as many."""
    token = text[start:end]
    digits = "".join(c for c in token if c.isdigit())
    before = _WORD.findall(text, max(0, start - 24), start)
    parts = token.split(".")
    said = (
        "bias",
        "shape " + shape(token.lstrip("+")),
        f"digits {min(len(digits), 20)}",
        f"card {12 <= len(digits) <= 19 and luhn(digits)} {len(digits) == len(token)}",
        f"address {len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)} {'@' in token and '.' in token.partition('@')[2]}",
        "before " + (before[-1].lower()[:12] if before else ""),
    )
    return [zlib.crc32(x.encode()) % FEATURES for x in said]


def _variants(text: str, base: list[tuple[int, int, int]], draw: random.Random) -> list[tuple[str, int]]:
    """Writings that the patterns do not find, with their labels: of what a text has, and of what it has not."""
    out = []
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    for a, label, b in base:
        said, digits = text[a:b], "".join(c for c in text[a:b] if c.isdigit())
        kind = KINDS[label - 1]
        if kind == "phone":
            out.append((f"{digits[-7:-4]}-{digits[-4:]}", label))
        elif kind == "email":
            out.append((said.partition("@")[0], label))
        elif kind == "card":
            i = draw.randrange(len(digits))
            out.append((digits[:i] + draw.choice([d for d in "0123456789" if d != digits[i]]) + digits[i + 1 :], label))
    draw.shuffle(out)
    return out[:4] + [(f"{number(3)}-{number(4)}", 0), (number(draw.randint(13, 17)), 0)]


def examples(text: str) -> tuple[list, list, list, list]:
    """Features, labels, edges of a text's tokens with hidden mentions added at its end, and whether a label is told: 0 no, 1 by the patterns, 2 of a hidden mention."""
    base = base_spans(text)
    draw = random.Random(hashlib.sha256(text.encode("utf-8", "replace")).digest())
    hidden = []
    if base:
        said = _WORD.findall(text, 0, 4_000)[:200] or ["and"]
        text += "\n"
        for piece, label in _variants(text, base, draw):
            text += " " + draw.choice(said) + " "
            hidden.append((len(text), label))
            text += piece + " " + draw.choice(said)
        base = base_spans(text)
    spans, labels, keys = nodes(text, base)
    edges, at = _edges(text, spans, keys), dict(hidden)
    shown = _hubs(labels, edges)
    kind = dict(zip(keys, labels, strict=True))
    for key, label in zip(keys, labels, strict=True):
        kind[key] = kind[key] or label
    told = [1] * len(spans)
    for i, (start, _) in enumerate(spans):
        if start in at and not labels[i]:
            labels[i], told[i] = at[start], 2
        elif not labels[i] and keys[i] and kind[keys[i]]:
            told[i] = 0  # missed or not: the patterns do not say
    return [features(text, a, b) for a, b in spans], labels + shown, edges, told


def training_sample(texts: DataFrame, size: int = SAMPLE) -> list[tuple]:
    """examples() of the size texts of least hash among those with 1 to MOST candidates; repeated texts are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py()
                if not text or not ("@" in text or _DIGIT.search(text)):
                    continue
                if 0 < len(nodes(text, base_spans(text))[0]) <= MOST:
                    rows.append((hashlib.sha256(text.encode()).digest()[:16], json.dumps(examples(text))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["h", "nodes"])

    found = batched(texts).mapInArrow(run, "h binary, nodes string").groupBy("h").agg(F.first("nodes").alias("nodes"))
    return [tuple(json.loads(r["nodes"])) for r in found.orderBy("h").limit(size).collect()]


class Field:
    """Weights of features by label, matrices of edge potentials (logarithms): chain, equal, similar; and each kind's threshold."""

    def __init__(self, sample: list[tuple], steps: int = 80, rate: float = 0.3):
        self.weights = np.zeros((FEATURES, LABELS))
        self.prior = np.stack([np.eye(LABELS) * c for c in CONSISTENT])
        # repetitions of a token are alike without a kind too; similar tokens without one say nothing of each other
        self.prior[[CHAIN, SIMILAR], 0, 0] = 0.0
        self.links = self.prior.copy()
        self.sure = np.full(LABELS, SURE)
        if sample:
            kept = [x for i, x in enumerate(sample) if i % HELD] or sample
            self._train(kept, steps, rate)
            self._settle(sample[::HELD])

    def _train(self, sample: list[tuple], steps: int, rate: float) -> None:
        """Most likely labels of each token, given those of its neighbours and hubs (pseudo-likelihood), by Adam."""
        sizes = [len(x[1]) for x in sample]
        first = np.cumsum([0, *sizes])
        y = np.array([v for x in sample for v in x[1]])
        # hubs have no features and teach nothing themselves
        own = np.concatenate([np.arange(n) < len(x[0]) for n, x in zip(sizes, sample, strict=True)])
        f = np.array([v for x in sample for v in x[0]])
        e = np.array([(i + a, j + a, k) for a, x in zip(first, sample, strict=False) for i, j, k in x[2]] or np.zeros((0, 3)), np.int64)
        # each end sees the other one's label; chain matrices are read from both sides
        to, of, kind, turned = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]], np.r_[e[:, 2], e[:, 2]], np.arange(2 * len(e)) < len(e)
        told = np.zeros(len(y), bool)
        told[own] = np.array([v for x in sample for v in x[3]]) > 0
        # a token without a kind that is linked to one with a kind is no example, unless its label is known
        sure = np.zeros(len(y), bool)
        sure[own] = np.array([v for x in sample for v in x[3]]) == 2
        told[to[(kind != CHAIN) & (y[to] == 0) & (y[of] > 0) & ~sure[to]]] = False
        on = told[to] & (told[of] | ~own[of])
        to, of, kind, turned = to[on], of[on], kind[on], turned[on]
        state = [np.zeros_like(x) for x in (self.weights, self.weights, self.links, self.links)]
        for t in range(1, steps + 1):
            logit = np.zeros((len(y), LABELS))
            logit[own] = self.weights[f].sum(1)
            table = np.where(turned[:, None, None], self.links[kind].transpose(0, 2, 1), self.links[kind])
            np.add.at(logit, to, table[np.arange(len(to)), y[of]])
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p[~told] = 0.0
            g_weights, g_links = PRECISION * self.weights, (1 + len(sample) * FIRM) * (self.links - self.prior)
            np.add.at(g_weights, f.ravel(), np.repeat(p[own], f.shape[1], 0))
            straight, back = np.zeros_like(self.links), np.zeros_like(self.links)
            np.add.at(straight, (kind[~turned], y[of[~turned]]), p[to[~turned]])
            np.add.at(back, (kind[turned], y[of[turned]]), p[to[turned]])
            g_links += straight + back.transpose(0, 2, 1)
            for x, g, m, v in ((self.weights, g_weights, *state[:2]), (self.links, g_links, *state[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def _settle(self, held: list[tuple]) -> None:
        """Each kind's threshold, on texts that were not trained on: hidden mentions are to be found, what the patterns pass over is not, unless it is linked to a kind."""
        seen = []
        for f, labels, edges, told in held:
            own = np.array(labels[: len(f)])
            asked = np.flatnonzero((np.array(told) == 2) | (np.array(told) == 1) & (own == 0))
            if not len(asked):
                continue
            # what the patterns found is evidence, the others are asked for
            base = [y if t == 1 else 0 for y, t in zip(labels, told, strict=False)] + labels[len(f) :]
            p = self._beliefs(f, base, edges)
            seen += [(labels[i], int(p[i, 1:].argmax()) + 1, p[i, 1:].max()) for i in asked]
        for k in range(1, LABELS):
            own = sorted((p, y == k) for y, said, p in seen if said == k)
            for t in np.arange(0.5, 1.0, 0.05):
                hit = [right for p, right in own if p >= t]
                if hit and np.mean(hit) >= RIGHT:
                    self.sure[k] = t
                    break

    def _beliefs(self, f: list, labels: list[int], edges: list) -> np.ndarray:
        """Marginals of tokens and hubs; those with a label are evidence."""
        unary, known = np.zeros((len(labels), LABELS)), np.flatnonzero(labels)
        unary[: len(f)] = self.weights[np.array(f)].sum(1)
        unary[known] = -1e6  # however many others say otherwise
        unary[known, np.array(labels)[known]] = 0.0
        return self.marginals(unary, edges)

    def marginals(self, unary: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy sum-product over the edges; log potentials in, probabilities out. All messages are sent together."""
        if not edges:
            b = np.exp(unary - unary.max(1, keepdims=True))
            return b / b.sum(1, keepdims=True)
        i, j, k = (np.array(x) for x in zip(*edges, strict=True))
        source, target = np.r_[i, j], np.r_[j, i]
        table = np.exp(np.concatenate((self.links[k], self.links[k].transpose(0, 2, 1))))
        back = np.r_[np.arange(len(i)) + len(i), np.arange(len(i))]
        m, damp, rounds, moved = np.zeros((len(source), LABELS)), DAMP, 0, 1.0
        while moved >= 1e-4:
            belief = unary.copy()
            np.add.at(belief, target, m)
            out = belief[source] - m[back]
            new = np.log(np.einsum("el,elk->ek", np.exp(out - out.max(1, keepdims=True)), table))
            new = (1 - damp) * (new - new.max(1, keepdims=True)) + damp * m
            moved, m, rounds = np.abs(new - m).max(), new, rounds + 1
            if rounds % 50 == 0:  # messages that swing come to rest
                damp = (1 + damp) / 2
        belief = unary.copy()
        np.add.at(belief, target, m)
        b = np.exp(belief - belief.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, label, end) of what the field adds to the base spans."""
        spans, labels, keys = nodes(text, base)
        if not spans or all(labels):
            return []
        edges = _edges(text, spans, keys)
        p = self._beliefs([features(text, a, b) for a, b in spans], labels + _hubs(labels, edges), edges)[: len(spans)]
        kind = p[:, 1:].argmax(1) + 1
        return [(spans[i][0], int(kind[i]), spans[i][1]) for i in np.flatnonzero((np.array(labels) == 0) & (p[np.arange(len(p)), kind] >= self.sure[kind]))]


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """The field, trained on a bounded sample of docs."""
    return Field(training_sample(docs.select(F.col(text_col).cast("string"))))


def find(docs: DataFrame, field: Field, text_col: str = "text", to: str = "pii") -> DataFrame:
    """docs with the spans of personal data: kind, start, end (code points), and whether a base pattern found it."""
    source = docs.drop(to).withColumn("_tl_text", F.col(text_col).cast("string"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(to, SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                if not text or not ("@" in text or _DIGIT.search(text)):
                    out.append([])
                    continue
                base = base_spans(text)
                found = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in field.added(text, base)])
                out.append([{"kind": KINDS[k - 1], "start": s, "end": e, "base": b} for s, k, e, b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], schema.names)
        release()

    return batched(source).mapInArrow(run, schema)
