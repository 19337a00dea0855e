"""Language identification by error-correcting output codes.

Every language has a codeword. One binary n-gram classifier for each bit predicts on which side of that split of the
languages a text lies; its weights are log odds of hashed byte n-grams, from counts over all training texts (counted in
the tasks, summed by Spark; the model is languages x buckets, whatever the corpus). Loss-weighted decoding adds for each
language the logistic losses of the bits' margins, weighted by how well a bit separates that language in training, and
takes the nearest codeword; a small lead over the second marks the text as ambiguous.

Cases: a null text or one without a letter is `und` with score 0; without training rows all are `und`; one language
alone is always predicted; a null doc_id is neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batched, pieces, release, utf8

BUCKETS = 1 << 15
ORDERS = (2, 3)
PIECE = 1 << 19
SMOOTH = 0.5
#: A lead of the best language's share over the second below this is ambiguous.
AMBIGUOUS = 0.2

#: Lower-cases ASCII letters; other ASCII characters become a space.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code for few languages, else the best spread of random codes."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if row == 0 or not (b + 1) >> (row - 1) & 1 else -1 for b in range(bits)] for row in range(n)], np.float64)
    draw = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    codes = [draw.choice([-1.0, 1.0], (n, length)) for _ in range(200)]
    return max(codes, key=lambda c: ((length - (c @ c.T)[~np.eye(n, dtype=bool)]) / 2).min())


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of the n-grams of folded bytes and the row of each; none crosses a row or holds two spaces running."""
    b = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in ORDERS:
        if len(b) < n:
            continue
        h = np.zeros(len(b) - n + 1, np.uint32)
        ok = row[: len(h)] == row[n - 1 :]
        for i in range(n):
            h = h * np.uint32(257) + b[i : len(h) + i]
            if i:
                ok &= (b[i - 1 : len(h) + i - 1] != 32) | (b[i : len(h) + i] != 32)
        h = h * np.uint32(0x9E3779B1) + np.uint32(n * 7919)
        yield (h >> np.uint32(17))[ok].astype(np.int64), row[: len(ok)][ok]


def _cut(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows as (bytes, offsets, row numbers); a long row comes in overlapping parts."""
    for a, b in pieces(at, PIECE):
        if b == a + 1 and at[b] - at[a] > PIECE:
            for start in range(int(at[a]), int(at[b]), PIECE):
                part = data[start : min(int(at[b]), start + PIECE + max(ORDERS) - 1)]
                yield part, np.array([0, len(part)]), np.array([a])
        else:
            yield data[at[a] : at[b]], at[a : b + 1] - at[a], np.arange(a, b)


class Model:
    """languages, codewords, the weights of each bit's classifier and the weight of each bit for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.codes = codewords(len(languages)) if languages else np.zeros((0, 0))
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True) if languages else np.zeros((0, BUCKETS))
        bits = []
        for code in self.codes.T:
            plus, minus = share[code > 0], share[code < 0]
            bits.append(np.log(plus.mean(0)) - np.log(minus.mean(0)) if len(plus) and len(minus) else np.zeros(BUCKETS))
        self.weights = np.array(bits, np.float32).T.copy() if bits else np.zeros((BUCKETS, 0), np.float32)
        sure = np.maximum(self.codes * (share @ self.weights), 1e-3) if languages else self.codes
        self.sure = sure / sure.sum(1, keepdims=True) if languages else sure

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(at) - 1, self.weights.shape[1])), np.zeros(len(at) - 1)
        for part, edges, rows in _cut(data, at):
            for h, row in grams(part, edges):
                if len(h):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    total[rows[row[first]]] += np.add.reduceat(self.weights[h], first, axis=0, dtype=np.float64)
                    n[rows[row[first]]] += np.diff(np.r_[first, len(row)])
        return total / np.sqrt(np.maximum(n, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number, its share and the lead over the second."""
        loss = np.stack([np.logaddexp(0, -margins * code) @ sure for code, sure in zip(self.codes, self.sure, strict=True)], 1) if self.languages else np.zeros((len(margins), 0))
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ranked = np.sort(p, 1)
        return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if len(self.languages) > 1 else 0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row of labelled whose label is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            distinct = sorted(set(names))
            code = np.array([distinct.index(x) for x in names])
            for part, edges, rows in _cut(*utf8(batch.column(0))):
                for h, row in grams(part, edges):
                    new = np.bincount(code[rows[row]] * BUCKETS + h, minlength=len(distinct) * BUCKETS).reshape(-1, BUCKETS)
                    for k, name in enumerate(distinct):
                        seen[name] = seen[name] + new[k] if name in seen else new[k].copy()
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})
        release()

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    sums = batched(rows).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, sums["lang"]) if languages else [], sums["bucket"]] = sums["n"]
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and ambiguous added, their names begun with prefix (columns of those names are replaced). A batch is read where it lies, without a copy of its texts as Python strings."""
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "ambiguous")]
    text = F.col(text_col).cast("string")
    source = docs.withColumns({"_tl_letters": F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), "_tl_text": text}).drop(*names)
    if text_col not in names and dict(docs.dtypes)[text_col] == "string":
        source = source.drop("_tl_text")
    at, letters = source.columns.index("_tl_text" if "_tl_text" in source.columns else text_col), source.columns.index("_tl_letters")
    own = [i for i, c in enumerate(source.columns) if c not in ("_tl_letters", "_tl_text")]
    schema = T.StructType([source.schema.fields[i] for i in own] + [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])
    words = pa.array([*model.languages, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, score, lead = model.decode(model.margins(*utf8(batch.column(at)))) if model.languages else (np.zeros(n, int), np.zeros(n), np.zeros(n))
            ok = batch.column(letters).to_numpy(zero_copy_only=False) & bool(model.languages)
            said = [words.take(pa.array(np.where(ok, best, len(model.languages)))), pa.array(np.where(ok, score, 0.0)), pa.array(ok & (lead < AMBIGUOUS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *said], schema.names)
        release()

    return batched(source).mapInArrow(run, schema)


def held_out(docs: DataFrame, parts: int, id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))
