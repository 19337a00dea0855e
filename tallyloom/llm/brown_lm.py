"""Scoring by a Brown class-based bigram model.

p(text) is the product over its tokens of p(class | class before) p(token | class). Words with a share of less than 1/HEAD
of the training tokens stand as one class where they come before, so the class before is known without a look-up. Training counts every word of every
training text: the tasks count, Spark sums, and the counts and classes stay a table that grows with the corpus.

Exchange clustering gives every word of the vocabulary a class, in three steps. All use the exchange criterion, the
likelihood of the class bigrams, and count words without a class yet as one class of their own:
 1. the words with a share of 1/CORE move between the classes, one at a time, until no move raises the likelihood;
 2. all others with a share of 1/HEAD move from the words without a class to where the likelihood grows most, by their
    neighbours in all texts;
 3. so do all that remain, a table of any size, by neighbours that now have classes for all words of steps 1 and 2.

A word unseen in training belongs to the class with the most distinct words.

What is broadcast has proven bounds: words with a share of 1/HEAD of all training tokens are HEAD at most. The counts and
classes of all other words meet their occurrences in a join by the word. No such word has more than 1/HEAD of the tokens,
so no key is hot. Rows are told by two hashes of what they hold, so a lost task can be run again over other row orders.

Cases: null text is empty and has its end only; a null doc_id is not held out and not learned from; rows that share a
doc_id are scored each; equal rows get equal scores; without training rows every word is unknown; a table without rows
gives none; columns other than those named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batched, discard, materialize, release, utf8

HEAD, CORE, CLASSES = 250_000, 1_500, 48
#: Added to each count; weight of the classes' own shares in the transitions.
ADD, BLEND = 0.1, 5.0
#: Bytes of text taken at once, distinct words counted before they are handed on.
BLOCK, FLUSH = 1 << 21, 200_000
END = b"\n"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(data: np.ndarray, at: np.ndarray, most: int = BLOCK) -> Iterator[list[tuple[int, int, int, bool]]]:
    """Lists of (row, start, end, last) of about most bytes; long rows are parted at white space."""
    out, size = [], 0
    for row in range(len(at) - 1):
        start, end = int(at[row]), int(at[row + 1])
        while True:
            to = end
            if end - start > most:
                found = np.flatnonzero(_SPACE[data[start + most : end]][: 1 << 16])
                if not len(found):
                    found = np.flatnonzero(_SPACE[data[start + most : end]])
                if len(found):
                    to = start + most + int(found[0])
            out.append((row, start, to, to == end))
            size += to - start
            if size >= most:
                yield out
                out, size = [], 0
            if to == end:
                break
            start = to
    if out:
        yield out


def tokens(raw: bytes) -> list[bytes]:
    """Words of raw with A-Z lower-cased: runs of bytes other than space and \\x09-\\x0D."""
    return raw.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """word (bytes; the end is a line feed), n, over one text column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            data, at = utf8(batch.column(0))
            for block in blocks(data, at):
                for _, start, end, last in block:
                    seen.update(tokens(data[start:end].tobytes()))
                    if last:
                        seen[END] += 1
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()
        release()

    return batched(texts).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def said(data: np.ndarray, block: list[tuple[int, int, int, bool]]) -> tuple[list[bytes], list[int]]:
    """The tokens of a block and how many each of its parts has."""
    words: list[bytes] = []
    sizes = []
    for _, start, end, last in block:
        part = tokens(data[start:end].tobytes())
        words += part
        if last:
            words.append(END)
        sizes.append(len(part) + last)
    return words, sizes


def look_up(table: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """The numbers of words in table; -1: none."""
    return np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int = CLASSES, fixed: int = 0) -> np.ndarray:
    """The class of each symbol. pairs: how often one symbol follows another. A symbol moves to the class where the class bigrams' likelihood grows most, until none moves: each move raises the likelihood, so that ends. The last fixed symbols have classes of their own, after all others."""
    n = len(pairs) - fixed
    k = min(classes, n)
    total = k + fixed
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[:n], kind="stable")
    of = np.empty(n + fixed, np.int64)
    of[order] = np.arange(n) % k if n else 0
    of[n:] = np.arange(k, total)
    one = np.zeros((n + fixed, total))
    one[np.arange(n + fixed), of] = 1
    after, before = pairs @ one, pairs.T @ one
    both = one.T @ after
    # far above the rounding of the sums, far below what matters: a gain by rounding could undo itself without end
    least = 1e-10 * abs(_gain(both).sum()) + 1e-9
    moved = True
    while moved:
        moved = False
        for s in order:
            out, into, self_n, a = after[s].copy(), before[s].copy(), pairs[s, s], of[s]
            if not out.any() and not into.any():
                continue
            # take s out of its class
            both[a] -= out
            both[:, a] -= into
            both[a, a] += self_n
            out[a] -= self_n
            into[a] -= self_n
            # what stands before s counts in its classes' rows wherever s goes, what follows it in columns
            left, right = both.sum(1) + into, both.sum(0) + out
            # as member of class c: row c gains out, column c gains into, (c, c) gains self_n as well
            rows, columns = _gain(both + out) - _gain(both), _gain(both + into[:, None]) - _gain(both)
            d = np.diagonal(both)
            score = rows.sum(1) + columns.sum(0) - np.diagonal(rows) - np.diagonal(columns) + _gain(d + out + into + self_n) - _gain(d)
            score -= _gain(left + out.sum() + self_n) - _gain(left) + _gain(right + into.sum() + self_n) - _gain(right)
            c = int(score[:k].argmax())
            if score[c] <= score[a] + least:
                c = int(a)
            out[c] += self_n
            into[c] += self_n
            both[c] += out
            both[:, c] += into
            both[c, c] -= self_n
            if c != a:
                moved = True
                of[s] = c
                after[:, a] -= pairs[:, s]
                after[:, c] += pairs[:, s]
                before[:, a] -= pairs[s]
                before[:, c] += pairs[s]
    return of


def place(both: np.ndarray, owner: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The classes of words that have none: for each, where the likelihood grows most if it joins.

    both: how often a class follows another; the last one holds the words without a class. Entries (owner, code, n) come
    by owner: the word with number owner stands n times after class code, or before class code - len(both).
    """
    size = len(both)
    k = size - 1
    table = np.concatenate((both[:, :k], both[:k].T))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    score = np.empty((len(first), k))
    step = max(1, (1 << 21) // k)
    edges, at = np.r_[first, len(owner)], 0
    while at < len(first):
        # whole words of about step entries; one word has 2 * size entries at most
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + step, "right")) - 1)
        a, b = edges[at], edges[to]
        t = table[code[a:b]]
        score[at:to] = np.add.reduceat(_gain(t + n[a:b, None]) - _gain(t), edges[at:to] - a, axis=0)
        at = to
    into, out = (np.add.reduceat(np.where(side, n, 0), first)[:, None] for side in (code < size, code >= size))
    left, right = both.sum(1)[None, :k], both.sum(0)[None, :k]
    score -= _gain(left + out) - _gain(left) + _gain(right + into) - _gain(right)
    return score.argmax(1)


def _entries(owner: np.ndarray, code: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by (owner, code), those of one cell summed."""
    key, at = np.unique(owner * (2 * size) + code, return_inverse=True)
    return key // (2 * size), key % (2 * size), np.bincount(at, n, len(key))


class Model:
    """Frequent words' counts and classes and the class tables that a task needs; other words' are in the table words (word, n, class)."""

    def __init__(self, words: DataFrame, total: int, distinct: int, head: dict[bytes, tuple[int, int]]):
        self.words, self.total, self.distinct, self.head = words, total, distinct, head

    def set_classes(self, follow: np.ndarray, totals: np.ndarray, types: np.ndarray) -> None:
        """follow: how often a class comes after another one, or (last row) after a rare word; totals and types: tokens and distinct words by class."""
        k = follow.shape[1]
        share = (totals + 1) / (totals.sum() + k)
        self.step = np.log10((follow + BLEND * share) / (follow.sum(1, keepdims=True) + BLEND))
        self.emit = -np.log10(totals + ADD * (types + 1))
        self.unseen = int(types.argmax())


def fit(texts: DataFrame) -> Model:
    """texts: one string column, nulls as empty."""
    batched(texts)
    words = materialize(count_words(texts), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    counts = {bytes(r["word"]): r["n"] for r in words.where((F.col("n") * HEAD >= total) | (F.col("word") == F.lit(END))).collect()}
    discard(words)
    core = sorted({w for w, n in counts.items() if n * CORE >= total} | {END})
    others = sorted(counts.keys() - set(core))

    # 1. the core, by the bigrams of its words and of one symbol for all others
    symbol, rest = {w: i for i, w in enumerate(core)}, len(core)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, carry = np.zeros((rest + 1) ** 2, np.int64), symbol[END]
        for batch in batches:
            data, at = utf8(batch.column(0))
            for block in blocks(data, at):
                of = look_up(symbol, said(data, block)[0])
                if len(of):
                    of[of < 0] = rest
                    n += np.bincount(np.r_[carry, of[:-1]] * (rest + 1) + of, minlength=len(n))
                    carry = of[-1]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": n[at]})
        release()

    seen = texts.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((rest + 1) ** 2)
    matrix[seen["pair"]] = seen["n"]
    matrix = matrix.reshape(rest + 1, -1)
    of = exchange(matrix, fixed=1)
    size = int(of[-1]) + 1
    one = np.eye(size)[of]
    classes = {w: int(of[i]) for w, i in symbol.items()}
    both = one.T @ matrix @ one
    none = size - 1

    def codes(table: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = look_up(table, words)
        return found, np.where((found < 0) | (found >= size), none, found)

    def with_neighbours(batches: Iterator[pa.RecordBatch], table: dict[bytes, int]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """Words, their numbers in table, and the classes before and after. The last token so far waits for the one after it."""
        waiting, before = [END], classes[END]
        for batch in batches:
            data, at = utf8(batch.column(0))
            for block in blocks(data, at):
                words = waiting + said(data, block)[0]
                found, code = codes(table, words)
                if len(words) > 1:
                    yield words, found, np.r_[before, code[:-2]], code[1:]
                    waiting, before = words[-1:], code[-2]

    # 2. other frequent words, by the classes of the core
    if others:
        table = classes | {w: size + i for i, w in enumerate(others)}

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(others) * 2 * size, np.int64)
            for _, found, before, after in with_neighbours(batches, table):
                on = np.flatnonzero(found[:-1] >= size)
                base = (found[on] - size) * (2 * size)
                at, times = np.unique(np.r_[base + before[on], base + size + after[on]], return_counts=True)
                n[at] += times
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"id": at // (2 * size), "code": at % (2 * size), "n": n[at]})
            release()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [batch.column(i) for i in (1, 2)]
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
                got = place(both, owner, *(x.flatten().to_numpy() for x in lists)) if len(owner) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "class": got})

        # a word has 2 * size codes at most
        sums = texts.mapInArrow(frequent, "id long, code long, n long").groupBy("id", "code").agg(F.sum("n").alias("n"))
        lists = sums.groupBy("id").agg(F.collect_list(F.struct("code", "n")).alias("z")).select("id", F.col("z.code").alias("code"), F.col("z.n").alias("n"))
        classes |= {others[r["id"]]: r["class"] for r in lists.mapInArrow(placed, "id long, class long").collect()}

    # 3. all that remain, by the classes of all frequent words
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size * size, np.int64)
        for words, found, before, after in with_neighbours(batches, classes):
            code = np.where(found < 0, none, found)
            n += np.bincount(code[:-1] * size + code[1:], minlength=len(n))
            on = np.flatnonzero(found[:-1] < 0)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in on.tolist()], pa.binary()), pa.array(before[on].astype(np.int16)), pa.array(after[on].astype(np.int16)), pa.array(np.ones(len(on), np.int64))], ["word", "before", "after", "n"])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array((at // size).astype(np.int16)), pa.array((at % size).astype(np.int16)), pa.array(n[at])], ["word", "before", "after", "n"])
        release()

    found = materialize(texts.mapInArrow(occurrences, "word binary, before short, after short, n long"), "occurrences")
    both = np.zeros((size, size))
    for r in found.where("word IS NULL").groupBy("before", "after").agg(F.sum("n").alias("n")).collect():
        both[r["before"], r["after"]] = r["n"]

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with all their occurrences running; the last word of a batch waits for the next one."""
        gathered = np.zeros((size, 2 * size))
        held: tuple[bytes, np.ndarray] | None = None

        def decide(words: pa.Array, owner, code, n):
            of = place(both, owner, code, n)
            np.add.at(gathered, (of[owner], code), n)
            count = np.bincount(owner, np.where(code < size, n, 0), len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([words, pa.array(count), pa.array(of.astype(np.int16)), pa.nulls(len(words), pa.int32())], ["word", "n", "class", "code"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0)
            new = np.r_[True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]
            owner, names = np.cumsum(new) - 1, word.filter(pa.array(new))
            code = np.r_[batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64) + size].astype(np.int64)
            owner, n = np.r_[owner, owner], np.ones(len(code))
            if held is not None:
                other = names[0].as_py() != held[0]
                if other:
                    names, owner = pa.concat_arrays([pa.array([held[0]], pa.binary()), names]), owner + 1
                at = np.flatnonzero(held[1])
                owner, code, n = np.r_[np.zeros(len(at), np.int64), owner], np.r_[at, code], np.r_[held[1][at], n]
            owner, code, n = _entries(owner, code, n, size)
            last = len(names) - 1
            on = owner == last
            vector = np.zeros(2 * size)
            vector[code[on]] = n[on]
            held = (names[last].as_py(), vector)
            if last:
                yield decide(names.slice(0, last), owner[~on], code[~on], n[~on])
        if held is not None:
            at = np.flatnonzero(held[1])
            yield decide(pa.array([held[0]], pa.binary()), np.zeros(len(at), np.int64), at, held[1][at])
        of, code = np.nonzero(gathered)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.binary()), pa.array(gathered[of, code].astype(np.int64)), pa.array(of.astype(np.int16)), pa.array(code.astype(np.int32))], ["word", "n", "class", "code"])
        release()

    dealt = found.where("word IS NOT NULL").select("word", "before", "after").repartition("word").sortWithinPartitions("word")
    classed = materialize(dealt.mapInArrow(remaining, "word binary, n long, class short, code int"), "classes")
    discard(found)
    # what follows each class, the words of step 3 as one: into frequent words, then into those words by their class
    follow, totals, types = both[:, :none].copy(), np.zeros(none), np.zeros(none)
    for r in classed.where(f"word IS NULL AND code < {size}").groupBy("class", "code").agg(F.sum("n").alias("n")).collect():
        follow[r["code"], r["class"]] += r["n"]
    for r in classed.where("word IS NOT NULL").groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        totals[r["class"]], types[r["class"]] = r["n"], r["kinds"]
    for w, n in counts.items():
        totals[classes[w]] += n
        types[classes[w]] += 1
    model = Model(classed.where("word IS NOT NULL").select("word", "n", "class"), total, distinct, {w: (n, classes[w]) for w, n in counts.items()})
    model.set_classes(follow, totals, types)
    model.end = classes[END]
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """For each row, the columns keep, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    classes, logs = {w: c for w, (_, c) in model.head.items()}, np.log10(np.array([n for n, _ in model.head.values()] or [0]) + ADD)
    numbers = {w: i for i, w in enumerate(classes)}
    of = np.array([*classes.values()] or [0])
    if END not in numbers:
        # nothing was learned: the end is a token that counts nothing
        numbers[END], logs, of = len(numbers), np.r_[logs[: len(numbers)], np.log10(ADD)], np.r_[of[: len(numbers)], model.end]
    end, end_known, first = numbers[END], END in model.head, model.end
    step, emit, rare = model.step, model.emit, len(model.step) - 1
    lead = len(keep)

    # rows: two hashes of the row; of a block the columns kept and sums over the frequent words; of each rare word the word and the class before
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(*keep, text.alias("_tl_text"))
    source = source.select(*keep, F.xxhash64(*keep, "_tl_text").alias("_tl_r"), F.xxhash64(F.lit(1), *keep, "_tl_text").alias("_tl_s"), "_tl_text")
    kept = [T.StructField(f"k{i}", source.schema[i].dataType) for i in range(lead)]
    made = [T.StructField(n, t) for n, t in (("r", T.LongType()), ("s", T.LongType()), ("word", T.BinaryType()), ("before", T.ShortType()), ("tokens", T.LongType()), ("known", T.LongType()), ("ends", T.LongType()), ("logs", T.DoubleType()), ("model", T.DoubleType()))]
    schema = T.StructType([*kept, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = first
        for batch in batches:
            data, at = utf8(batch.column(lead + 2))
            keys = [batch.column(lead + i).to_numpy() for i in (0, 1)]
            for block in blocks(data, at):
                words, sizes = said(data, block)
                rows, edges = np.array([p[0] for p in block]), np.r_[0, np.cumsum(sizes)]
                found = look_up(numbers, words)
                known = found >= 0
                own = np.where(known, of[found], rare)
                before = np.r_[carry, own[:-1]][: len(own)]
                carry = own[-1] if len(own) else carry
                run_sum = lambda x, edges=edges: np.diff(np.r_[0, np.cumsum(x)][edges])
                counted = known if end_known else known & (found != end)
                steps = np.zeros(len(own))
                steps[known] = step[before[known], own[known]] + emit[own[known]] + logs[found[known]]
                # a block comes under a key of its own that no word equals
                lone = pa.array([b" %d" % k for k in keys[0][rows].tolist()], pa.binary())
                none = lambda kind, n=len(rows): pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(lead)), pa.array(keys[0][rows]), pa.array(keys[1][rows]), lone, none(pa.int16()), pa.array(np.diff(edges).astype(np.int64)), pa.array(run_sum(counted).astype(np.int64)), pa.array(np.array([p[3] for p in block], np.int64)), pa.array(run_sum(np.where(known, logs[found], 0.0))), pa.array(run_sum(steps))], schema.names)
                on = np.flatnonzero(~known)
                part = rows[np.searchsorted(edges, on, "right") - 1]
                none = lambda kind, n=len(on): pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([*(none(batch.column(i).type) for i in range(lead)), pa.array(keys[0][part]), pa.array(keys[1][part]), pa.array([words[i] for i in on.tolist()], pa.binary()), pa.array(before[on].astype(np.int16)), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], schema.names)
        release()

    spark = docs.sparkSession
    # one row for each pair of classes: bounded by CLASSES
    terms = spark.createDataFrame([(h, c, float(step[h, c] + emit[c])) for h in range(rare + 1) for c in range(step.shape[1])], "before short, class short, term double")
    joined = batched(source).mapInArrow(run, schema).join(model.words, "word", "left").withColumn("class", F.coalesce("class", F.lit(model.unseen).cast("short")))
    joined = joined.join(F.broadcast(terms), ["before", "class"], "left")
    is_word, log = F.col("before").isNotNull(), F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    each = joined.select(
        *[f"k{i}" for i in range(lead)],
        "r",
        "s",
        "tokens",
        F.when(is_word, F.col("n").isNotNull().cast("long")).otherwise(F.col("known")).alias("known"),
        F.when(is_word, log).otherwise(F.col("logs")).alias("logs"),
        F.when(is_word, log + F.col("term")).otherwise(F.col("model")).alias("model"),
        "ends",
    )
    sums = each.groupBy("r", "s").agg(*[F.max(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.sum(c).alias(f"_tl_{c}") for c in ("tokens", "known", "logs", "model")], F.sum("ends").alias("_tl_times"))
    return _finished(sums, keep, model)


def _finished(sums: DataFrame, keep: tuple[str, ...], model: Model) -> DataFrame:
    """The result's rows from the sums by row hashes. Equal rows came together, and each gets its share."""
    norm = float(np.log10(model.total + ADD * (model.distinct + 1)))
    times = F.col("_tl_times")
    rows = sums.withColumns({"n_tokens": F.expr("_tl_tokens div _tl_times"), "n_known": F.expr("_tl_known div _tl_times"), "_tl_logs": F.col("_tl_logs") / times, "_tl_model": F.col("_tl_model") / times, "_tl_each": F.explode(F.sequence(F.lit(1), times))})
    return rows.select(*keep, "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("_tl_logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), F.col("_tl_model").alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
