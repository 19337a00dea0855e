"""The text operators against brute force on small fixtures, with the awkward cases."""

import hashlib
import itertools
import math
import time
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import brown_lm, bpe, chat_format, components, dart_minhash, decontaminate, entry, exact_dedup, html_extract, langid, line_dedup, pii

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, kept string, _x int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:2] + ((r[2] if len(r) > 2 else None), (r[3] if len(r) > 3 else None), "k", 1) for r in rows], DOCS)


LONG = "word " * 60_000


@pytest.fixture(scope="module")
def sample(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


# ------------------------------------------------------------------ exact


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(3)]
    parts[1][:100] = parts[0][:100]
    want = Counter(np.concatenate(parts).tolist())
    assert [exact_dedup.range_bits(n) for n in (0, 10**6, 16 * 500_000 + 1, 10**11)] == [4, 4, 5, 18]
    for bits in (0, 4, 9, 18, 40):
        blocks = defaultdict(list)
        for p in parts:
            for k, b in exact_dedup.build_filter(p, bits).items():
                blocks[k].append(b)
        got = Counter()
        for k, bs in blocks.items():
            slots, counts = exact_dedup.merge_filters(bs, k, bits)
            assert (np.diff(slots.astype(object)) > 0).all()
            got.update(dict(zip(slots.tolist(), counts.tolist(), strict=True)))
        assert got == want


def test_exact_cases(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (2, None), (3, ""), (None, "z"), (7, "a "), (8, LONG), (9, LONG), (None, "a")]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert got == sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha(t)) for i, t in rows), key=str)
    kept = exact_dedup.keep_distinct(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and sorted(r[0] for r in kept.collect() if r[0] is not None) == [3, 5, 5, 7, 9]
    assert exact_dedup.exact_dedup(docs(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------ chat


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<", "", None, "é😀<\\\\|", "a<|", LONG]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate(zip(["user", "assistant", "sys\ntem", None] * 2, odd, strict=True))]
    rows += [(3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


# ------------------------------------------------------------------ bpe


def test_bpe_equals_the_library(spark, sample):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own, lib = bpe.Tokenizer(path), Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    draw = random.Random(4)
    letters = [chr(i) for i in range(128)] + list("éÉèçñÑüÜßłİΣσςά́̈ ½²Ⅷ\x85中文кД١😀ﬁﷺẞ‍")
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(draw.choice(["<|startoftext|>", "<|endoftext|>", "<|", "It's ", "x" * 90, "é" * 70, "tion" * 40]) for _ in range(8)) for _ in range(300)]
    texts += [t or "" for _, t in sample] + [LONG]
    for text, packed in zip(texts, own.encode_all(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert own.decode(packed) == lib.decode(want, skip_special_tokens=False)
    done = bpe.decode(bpe.encode(docs(spark, [(1, None), (2, "")]), path), path).select("token_ids", "decoded").collect()
    assert [tuple(r) for r in done] == [(b"", ""), (b"", "")]


def test_forced_cuts_are_inside_no_token():
    public = pytest.importorskip("public_tokenizers")
    own = bpe.Tokenizer(public.path("word_bpe_49k.json"))
    assert not own.inside[ord("q"), ord("#")] and own.inside[ord("t"), ord("h")]
    assert 4 in own.fragments(np.frombuffer(b"theq#the", np.uint8), np.array([8])).tolist()


# ------------------------------------------------------------------ near


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a = np.arange(1, 121, dtype=np.uint64)
    wa, wb = rng.integers(0, 5, 120).astype(float), rng.integers(0, 5, 120).astype(float)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    on_a, on_b = wa > 0, wb > 0
    h = dart_minhash.mix(a)
    s = dart_minhash.darts(np.r_[h[on_a], h[on_b]], np.r_[np.zeros(on_a.sum(), int), np.ones(on_b.sum(), int)], np.r_[wa[on_a], wb[on_b]], 2, 2000)
    assert (s != 0).all() and abs((s[0] == s[1]).mean() - want) < 0.05


def brute_classes(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def sh(t):
        w = re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").translate(low).encode())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = [(i, sh(t)) for i, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and (a & b).total() >= 0.8 * (a | b).total():
                root[max(find(x), find(y))] = min(find(x), find(y))
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    return Counter((i, min((j for j in least[find(x)] if j is not None), default=None)) for x, (i, _) in enumerate(sets))


def test_near_classes(spark, sample):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    rows = list(sample)
    for k in range(60):  # copies of one text, few of them near each other
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((10_000 + k, " ".join(copy[: draw.choice([120, 120, 100, 90])])))
    for k in range(12):  # a passage that is repeated more or less often: the weights tell
        rows.append((15_000 + k, " ".join(base[:40] * (k + 1))))
    rows += [(20_001, None), (20_002, ""), (20_003, "One two."), (20_004, "one TWO"), (None, "one two"), (20_005, LONG), (20_006, LONG), (20_007, "a b c d e"), (20_007, "A b c d e!")]
    got = Counter((r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert dart_minhash.near_duplicates(docs(spark, rows[:1]).limit(0)).count() == 0


def test_similarity_of_exactly_four_fifths_outside_the_hub(spark, monkeypatch):
    # all nodes in one bucket: a copy cut to 28 of 35 shingles is compared with its source only outside the hub's component
    sign = dart_minhash.sign
    monkeypatch.setattr(dart_minhash, "sign", lambda *a, **b: sign(*a, **b).withColumn("bands", F.array(F.lit(1).cast("long"))))
    rows = []
    for k in range(12):
        n = 5 * (k % 6 + 6)  # shingles
        own = [f"w{k}x{i}" for i in range(n + 4)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: n // 5 * 4 + 4]))]
    got = Counter((r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_classes(rows) == Counter((i, i - i % 2) for i, _ in rows)


def test_components(spark):
    draw = random.Random(8)
    links = [(draw.randint(1, 60), draw.randint(1, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)}}


# ------------------------------------------------------------------ decontamination, lines


def test_leaks(spark):
    train = "If a train leaves Paris at 60 km per hour and runs for 3 hours, how far will the train of Anna be from Paris?"
    plain = "Plain words without any slot stand here in a row for all of us."
    sums = "What is 12 + 7 - 3 * 4 and 17 km + 20 km?"
    long = ". ".join(f"Alpha{i} stands by beta{i} and gamma{i} at delta{i}" for i in range(14)) + "."
    run = " ".join(long.split()[20:45])
    items = spark.createDataFrame([(1, train), (2, plain), (3, "Too short"), (4, None), (5, "one two three four five"), (6, sums), (7, long), (8, "+ -"), (9, "Who wrote Hamlet?"), (10, "What is 12 km plus 45 km minus 7 km times 3 in total?"), (11, "Compute 17 + 20 * 3 - 4 / 2 = 9 or 11 now."), (12, "1 2 3 4 5 6 7 8 1")], "item_id long, text string")
    rows = [
        (1, f"Intro. {train} End."),
        (2, "If a train leaves London at 75 km per hour and runs for five hours, how far will the train of Maria be from London?"),
        (3, "If a train leaves London at 75 km per hour and runs for 5 hours, how far will the train of Maria be from Oslo?"),
        (4, "PLAIN WORDS without any slot\nstand here in a row for all of us"),
        (5, None), (6, ""), (7, "nothing of it " * 30), (8, "say one two three four five now"), (None, plain), (9, LONG),
        (10, f"asked: {sums}"), (11, "What is 13 + 8 - 5 * 9 and 4 km + 21 km?"), (12, "too  short."), (13, "it is too short"),
        (14, train.lower()), (15, long.replace(".", "")), (16, f"said {run} and no more"), (17, "said " + " ".join(run.split()[:20])), (18, train.upper()),
        (19, "So. Too short. And on"), (20, "What is 13 + 8 - 5 * 9 and 4 km + 21 m?"), (21, "What is 17 + 7 - 17 * 4 and 12 km + 20 km?"), (22, "Q: Who wrote Hamlet? A: he"), (23, "He asked who wrote Hamlet? too"),
        (24, "Then: What is 13 km plus 46 km minus 8 km times 5 in total? Yes."), (25, "Compute 1 + 2 * 9 - 8 / 4 = 3 or 6 now."), (26, "Compute 1 + 2 * 9 - 8 / 4 = 3 or 6 later."), (27, "Compute 5 + 5 * 5 - 5 / 5 = 5 or 5 now."),
        (28, "9 8 7 6 5 4 3 2 1 " * 300),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    # 11, 24, 25, 27: other numbers in the whole template (27: one value for all slots); not 20: one unit became two; 21: numbers that the item tells apart or not otherwise; 23: not a sentence of its own
    want = {(1, 1), (2, 1), (4, 2), (8, 5), (None, 2), (10, 6), (11, 6), (12, 3), (14, 1), (15, 7), (16, 7), (18, 1), (19, 3), (21, 6), (22, 9), (24, 10), (25, 11), (27, 11)}
    assert set(got) == want
    assert not got[11, 6]["verbatim"] and got[10, 6]["verbatim"] and got[25, 11]["coverage"] == 1.0
    assert got[1, 1]["verbatim"] and not got[2, 1]["verbatim"] and got[2, 1]["n_slots"] > 0 and got[4, 2]["coverage"] == got[14, 1]["coverage"] == got[18, 1]["coverage"] == got[15, 7]["coverage"] == 1.0
    assert sorted(r[0] for r in decontaminate.keep_clean(docs(spark, rows), items).collect() if r[0]) == [3, 5, 6, 7, 9, 13, 17, 20, 23, 26, 28]
    assert decontaminate.leaks(docs(spark, rows).limit(0), items).count() == 0 == decontaminate.leaks(docs(spark, rows), items.limit(0)).count()


def test_lines(spark):
    rows = [(i, f"shared line\nown {i}\n\nfew {i % 3}", None, f"s{i}") for i in range(12)] + [(50, None, None, None), (51, "shared line", None, None), (52, "  shared line \r\nx", None, "s1"), (52, "  shared line \r\nx", None, "s1"), (53, LONG, None, "s2")]
    got = sorted((tuple(r) for r in line_dedup.remove_boilerplate(docs(spark, rows)).collect()), key=str)
    sites = defaultdict(set)
    for _, t, _, s in rows:
        for line in (t or "").split("\n"):
            if s is not None:
                sites[line.strip(" \t\r")].add(s)
    keep = lambda t: [x for x in (t or "").split("\n") if not x.strip(" \t\r") or len(sites[x.strip(" \t\r")]) < 10]
    assert got == sorted(((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(keep(t)), "\n".join(keep(t))) for i, t, _, s in rows), key=str)


# ------------------------------------------------------------------ models


def test_language(spark):
    got = entry.op8_language_id(spark, "/root/testdata/sf0.01").alias("g").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    model = langid.fit(docs(spark, [(i, t, lang) for i in range(5) for t, lang in (("the cat sat on the mat", "en"), ("der hund und die katze", "de"))]))
    rows = langid.identify(docs(spark, [(1, "the mat"), (2, "die katze"), (3, None), (4, "123 !!"), (5, ""), (6, "und der " * 100_000)]), model)
    assert [r["lang_pred"] for r in rows.orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und", "de"]
    none = langid.fit(docs(spark, [(1, "x", None)]))
    assert langid.identify(docs(spark, [(1, "x")]), none).first()["lang_pred"] == "und"


def test_codewords_are_apart():
    for n in (2, 3, 5, 9):
        c = langid.codewords(n)
        gap = (c.shape[1] - (c @ c.T)[~np.eye(n, dtype=bool)]) / 2
        assert gap.min() >= max(1, c.shape[1] // 4)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + ["\n"]


@pytest.mark.parametrize("head", [brown_lm.HEAD, 3_000])
def test_scores(spark, sample, head, monkeypatch):
    # with a small HEAD most words are placed by the table that grows with the corpus
    monkeypatch.setattr(brown_lm, "HEAD", head)
    rows = [*sample, (9_001, None), (9_002, ""), (9_003, "İ x\x1cy a b\x0bc"), (9_003, "again"), (9_004, LONG)]
    df = docs(spark, rows)
    out = langid.held_out(df, 10)
    model = brown_lm.fit(df.where(~out).select("text"))
    got = {(r["doc_id"], r["n_tokens"]): r for r in brown_lm.score(df.withColumn("held_out", out), model, ("doc_id", "held_out")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i, len(tokens(t))]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens(t)) and r["train_tokens"] == n and r["held_out"] == held[i] and r["base_score"] == pytest.approx(want, rel=1e-9)
    own = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
    # every word has a class, and the score is what the model's tables say of the text
    classes = {w.decode(): c for w, (_, c) in model.head.items()} | {bytes(r["word"]).decode(): r["class"] for r in model.words.collect()}
    assert set(classes) == set(counts) and (head > 3_000 or model.words.count() > 0.9 * len(counts))
    for i, t in rows:
        before, want = model.end, 0.0
        for w in tokens(t):
            c = classes.get(w, model.unseen)
            want += model.step[before, c] + model.emit[c] + math.log10(counts[w] + 0.1)
            before = c if w.encode() in model.head else len(model.step) - 1
        assert got[i, len(tokens(t))]["score"] == pytest.approx(want, rel=1e-9, abs=1e-6)  # large sums cancel in a long text
    empty = brown_lm.fit(df.limit(0).select("text"))
    assert brown_lm.score(df, empty).agg(F.max("n_known")).first()[0] == 0
    assert brown_lm.score(df.limit(0), model).count() == 0
    twice = brown_lm.score(df.unionAll(df).withColumn("score", F.lit("x")), model, ("doc_id", "lang"))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in twice.collect()) == Counter((i, len(tokens(t))) for i, t in rows * 2)


def likelihood(both):
    g = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return g(both) - g(both.sum(0)) - g(both.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 20, (30, 30)).astype(float)
    of = brown_lm.exchange(pairs, classes=5, fixed=1)
    assert set(of[:-1]) <= set(range(5)) and of[-1] == 5
    whole = lambda of: np.eye(6)[of].T @ pairs @ np.eye(6)[of]
    best = likelihood(whole(of))
    for s in range(29):
        for c in range(5):
            other = of.copy()
            other[s] = c
            assert likelihood(whole(other)) <= best + 1e-6
    m = brown_lm.Model(None, 0, 0, {})
    m.set_classes(whole(of)[:, :5], pairs.sum(0) @ np.eye(6)[of][:, :5], np.eye(6)[of][:, :5].sum(0))
    assert np.allclose((10**m.step).sum(1), 1)


def test_words_enter_the_likeliest_class():
    rng = np.random.default_rng(5)
    both = rng.integers(1, 60, (5, 5)).astype(float)
    into, out = rng.integers(0, 4, (40, 5)).astype(float), rng.integers(0, 4, (40, 5)).astype(float)
    into[:, 0] += 1
    owner, code = np.nonzero(np.hstack((into, out)))
    got = brown_lm.place(both, owner, code, np.hstack((into, out))[owner, code])
    for w in range(40):
        tries = []
        for c in range(4):
            now = both.copy()
            now[:, c] += into[w]
            now[c] += out[w]
            g = lambda x: float((x * np.log(x)).sum())
            # the word's own cells are counted from both sides, as it does not follow itself
            cells = sum(g(both[[j], c] + into[w, j]) - g(both[[j], c]) for j in range(5)) + sum(g(both[c, [j]] + out[w, j]) - g(both[c, [j]]) for j in range(5))
            tries.append(cells - g(both.sum(1)[[c]] + out[w].sum()) + g(both.sum(1)[[c]]) - g(both.sum(0)[[c]] + into[w].sum()) + g(both.sum(0)[[c]]))
        assert got[w] == int(np.argmax(tries))


# ------------------------------------------------------------------ personal data


def brute_spans(t):
    out = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    draw = random.Random(1)
    for _ in range(8000):
        t = "".join(draw.choice(["1", "2", "25", "256", "0", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "x@y.z", "4539578763621486", "\n", "é", "--"]) for _ in range(draw.randint(1, 24)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("a" * 1_000_000 + "@") == [] and pii.base_spans("1" * 300_000) == []


def test_repeated_token_is_found(spark):
    card = "4539578763621486"
    rows = [(i, f"pay with {card} now. Also 7536784127813050 {card} again") for i in range(3)] + [(100 + i, f"paid {card} then") for i in range(30)] + [(5, None), (6, ""), (7, "no data at all"), (8, "1234567890123456 is no card")]
    got = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["pii"]] for r in pii.find(docs(spark, rows), pii.fit(docs(spark, rows))).collect()}
    assert got[0] == [("card", True), ("card", False)] and got[5] == got[6] == got[7] == got[8] == []


def test_spaced_numbers_are_linked(spark):
    phone, card = "+1 415 555 2671", "4111 1111 1111 1111"
    text = f"call {phone} today, or 1 415 555 2671, or 14155552671, or 1-(415)-555-2671; pay {card} or 4111.1111.1111.1111 soon; room 415 555"
    spans, _, keys = pii.nodes(text, pii.base_spans(text))
    assert [text[a:b] for (a, b), k in zip(spans, keys, strict=True) if k == "14155552671"] == [phone, "1 415 555 2671", "14155552671", "1-(415)-555-2671"]
    assert [text[a:b] for (a, b), k in zip(spans, keys, strict=True) if k == "4111111111111111"] == [card, "4111.1111.1111.1111"]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    rows = [(1, text)] + [(10 + i, f"ring +1 415 555 {2000 + i} then, or +1 415 555 {2000 + i}; card {card}, or {card}") for i in range(40)]
    got = {r["doc_id"]: r["pii"] for r in pii.find(docs(spark, rows), pii.fit(docs(spark, rows))).collect()}[1]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in got if not s["base"]] == [("phone", "1 415 555 2671"), ("phone", "14155552671"), ("phone", "1-(415)-555-2671"), ("card", "4111.1111.1111.1111")]


def test_similar_tokens_are_linked():
    phone, mail = "+1 415 555 2671", "anna.smith@example.org"
    text = f"ring {phone}, later 555-2671; typed 1 415 555 2672; write {mail} and ask for anna.smith; not 999 1234"
    spans, labels, keys = pii.nodes(text, pii.base_spans(text))
    at = {text[a:b]: i for i, (a, b) in enumerate(spans)}
    kinds = {(i, j): k for i, j, k in pii._edges(text, spans, keys)}
    assert kinds[at[phone], at["555-2671"]] == pii.SIMILAR and kinds[at[mail], at["anna.smith"]] == pii.SIMILAR
    near = lambda a, b: any(k == pii.SIMILAR for _, _, k in pii._edges(f"{a}, {b}", [(0, len(a)), (len(a) + 2, len(a) + 2 + len(b))], [a, b]))
    assert near("14155552671", "14155552672") and not near("14155552671", "14155552682")
    numbers = "card 4111 1111 1111 1111, then 4111111111111112"
    spans, _, keys = pii.nodes(numbers, pii.base_spans(numbers))
    assert [k for _, _, k in pii._edges(numbers, spans, keys)] == [pii.SIMILAR]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(9)
    field = pii.Field([])
    field.links = rng.normal(0, 1, field.links.shape)
    for edges in ([], [(0, 1, 0), (1, 2, 1), (1, 3, 2)]):  # without loops the messages are exact
        unary = rng.normal(0, 1, (4, pii.LABELS))
        want = np.zeros_like(unary)
        for y in itertools.product(range(pii.LABELS), repeat=4):
            weight = math.exp(sum(unary[i, y[i]] for i in range(4)) + sum(field.links[k, y[i], y[j]] for i, j, k in edges))
            for i in range(4):
                want[i, y[i]] += weight
        assert np.allclose(field.marginals(unary, edges), want / want.sum(1, keepdims=True), atol=1e-3)
    # messages change labels: a token that looks like none takes the kind of its repetitions
    field, unary = pii.Field([]), np.full((3, pii.LABELS), -30.0)
    unary[[0, 2], 3], unary[1] = 0.0, [1.0, -1.0, -1.0, -1.0, -1.0]
    assert field.marginals(unary, [])[1].argmax() == 0 and field.marginals(unary, [(0, 1, pii.EQUAL), (1, 2, pii.EQUAL)])[1].argmax() == 3


@pytest.fixture(scope="module")
def field():
    texts = [f"write {'abcdefgh'[i % 8] * 3}{i}.name@example.org or ring +1 415 555 {2000 + i} then, pay {card} and see 10.0.{i}.7; order {7_000_000 + 7919 * i} of {4_000_000_000_000_000 + 99_991 * i * 7}" for i, card in enumerate(("4539578763621486", "4111111111111111", "5500005555555559", "340000000000009") * 30)]
    return pii.Field([pii.examples(t) for t in texts])


def added(field, text):
    return [(text[a:b], pii.KINDS[k - 1]) for a, k, b in field.added(text, pii.base_spans(text))]


def test_similar_tokens_are_added(field):
    assert added(field, "write anna.smith@example.org and ask for anna.smith there") == [("anna.smith", "email")]
    assert added(field, "ring +1 415 555 2671 later 555-2671 ok") == [("555-2671", "phone")]
    assert added(field, "pay 4111 1111 1111 1111 or 4111111111111112 now") == [("4111111111111112", "card")]
    # the same writings without the evidence, and repetitions of what is none
    assert added(field, "ask for anna.smith there, 555-2671 ok, 4111111111111112 now, 555-2671, 4111111111111112 and 4111111111111112") == []
    assert added(field, "ring +1 415 555 2671 later 555-9999, or pay 4111 1111 1111 1111 not 4222222222222223") == []


@pytest.mark.parametrize("n", [1, 2, 5, 20, 200])
def test_equal_tokens_have_one_label(field, n):
    text = "call +1 415 555 2671 " + "or 14155552671 please " * n
    assert added(field, text) == [("14155552671", "phone")] * n


def test_loops_come_to_rest():
    rng = np.random.default_rng(4)
    field, edges = pii.Field([]), [(0, 1, 0), (1, 2, 0), (0, 3, 1), (2, 3, 1), (1, 3, 2)]
    field.links = field.links * 0.3 + rng.normal(0, 0.2, field.links.shape)
    unary, want = rng.normal(0, 1, (4, pii.LABELS)), np.zeros((4, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=4):
        weight = math.exp(sum(unary[i, y[i]] for i in range(4)) + sum(field.links[k, y[i], y[j]] for i, j, k in edges))
        for i in range(4):
            want[i, y[i]] += weight
    got = field.marginals(unary, edges)
    want /= want.sum(1, keepdims=True)
    assert np.abs(got - want).max() < 0.1 and (got.argmax(1) == want.argmax(1)).all()
    # potentials that never agree: the messages would swing for ever
    field.links = np.stack([rng.normal(0, 6, (pii.LABELS, pii.LABELS)) for _ in range(3)])
    assert np.isfinite(field.marginals(unary, edges)).all()


def test_pii_cases(spark):
    card = "4539578763621486"
    rows = [(1, f"pay {card} now"), (1, f"pay {card} now"), (2, "9" * 100_000 + " " + "a@b.cc " * 20_000), (3, None), (None, "x 10.0.0.1 y")]
    frame = docs(spark, rows).withColumn("pii", F.lit("old"))
    field = pii.fit(frame)
    got = pii.find(frame, field)
    assert got.columns == [c for c in frame.columns if c != "pii"] + ["pii"] and field.weights.any()
    rows = [(r["doc_id"], [(s["kind"], s["base"]) for s in r["pii"]]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, [("card", True)])] * 2 + [(2, [("email", True)] * 20_000), (3, []), (None, [("ip", True)])], key=str)
    assert pii.find(frame.limit(0), field).count() == 0 and pii.find(frame, pii.fit(frame.limit(0))).count() == 5


# ------------------------------------------------------------------ pages


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head</h1><p>One &amp; <b>two</b><br>\n three.<p>Four.</article><section class="comments"><p>Reader says this is a rather long comment, with commas.</p></section><footer>&copy; x</footer></body></html>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>unclosed <b>text"), (5, "<div>" * 300 + "deep" + "</div>" * 300)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[1] == "Head\n\nOne & two three.\n\nFour." and got[2] == got[3] == ""


def test_html_cases(spark):
    body = "<body>Skip to content | Login<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><article><h1>Title of it</h1><p>First passage of the article, with some words in it. And more words follow here.</p><p>Second passage, also rather long. It ends here.</p></article>Copyright 2020 all rights reserved</body>"
    text = "Title of it\n\nFirst passage of the article, with some words in it. And more words follow here.\n\nSecond passage, also rather long. It ends here."
    plain = "This is a plain page without any element, with sentences. It goes on, and on."
    long = "<article>" + "".join(f"<p>Passage {i} of a long page, with words.</p>" for i in range(5000)) + "</article>"
    rows = [(1, body, "old"), (1, body, "old"), (2, plain, "old"), (3, "<p>One passage of text here, with words in it.</p><p>Two more sentences stand here. They end before the page is cut. <a hre", None), (4, long, None), (None, "<a " * 5, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "html", "text"]
    found = [(r["page_id"], r["text"]) for r in got.collect()]
    want = [(1, text), (1, text), (2, plain), (3, "One passage of text here, with words in it.\n\nTwo more sentences stand here. They end before the page is cut."), (4, "\n\n".join(f"Passage {i} of a long page, with words." for i in range(5000))), (None, "")]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_malformed_pages_cost_linear_time():
    for piece in ("<a ", '<a "', "<!", "</", "<a ='", "<script ", "<!-- ", "&lt;<", '<a href="', "<b>", "</x>"):
        began = time.time()
        html_extract.Page(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 10, piece


#: Pages in the manner of common site software, written by hand, with their main text.
KNOWN_PAGES = [
    (
        """<!doctype html><html><head><title>x</title></head><body class="single single-post"><div id="page"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Garden</a></p></div><nav class="main-navigation"><ul class="menu"><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></nav></header><div id="content" class="site-content"><main id="main"><article id="post-7" class="post type-post hentry"><h1 class="entry-title">Growing beans</h1><div class="entry-content"><p>Beans need warm soil, so wait until May. Sow them two inches deep.</p><p>Water them well, and put up poles early.</p></div></article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment">Great advice, thank you for this post!</li><li class="comment">Mine never come up, sadly.</li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">Peas</a></li><li><a href="/b">Kale</a></li></ul></section></aside><footer id="colophon" class="site-footer">Proudly powered by software</footer></div></body></html>""",
        ["Growing beans", "Beans need warm soil, so wait until May. Sow them two inches deep.", "Water them well, and put up poles early."],
    ),
    (
        """<html><body><div class="topnav"><a href="/docs">Docs</a> <a href="/api">API</a> <a href="/blog">Blog</a></div><div class="document"><section id="install"><h1>Installation</h1><p>Download the archive and unpack it. Then run the setup program.</p><h2>Requirements</h2><ul><li>A compiler for the language.</li><li>At least two gigabytes of memory.</li></ul></section></div><div class="footer">&copy; 2021 The authors.</div></body></html>""",
        ["Installation", "Download the archive and unpack it. Then run the setup program.", "Requirements", "A compiler for the language.", "At least two gigabytes of memory."],
    ),
    (
        """<html><body><div class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div><header><a href="/">The Daily</a></header><main><article><h1>Bridge opens after repairs</h1><p>The old bridge opened again on Monday, after two years of work. Hundreds came to see it.</p><div class="ad-slot">Buy our tyres today, at half the price.</div><p>The mayor said that the cost stayed within limits, which surprised many.</p></article><aside class="related"><h3>Related</h3><ul><li><a href="/1">Road closed</a></li><li><a href="/2">New tram</a></li></ul></aside></main><footer><p>Contact | Privacy | Terms</p></footer></body></html>""",
        ["Bridge opens after repairs", "The old bridge opened again on Monday, after two years of work. Hundreds came to see it.", "The mayor said that the cost stayed within limits, which surprised many."],
    ),
]


# names that say nothing or are foreign, headers and footers in the article: (page, main text)
PLAIN_PAGES = [
    ('<html><body><div class="zx9">We use cookies to make this site better. <button>OK</button></div><article><h1>Rain</h1><p>It rained all day in the valley, and the river rose by a foot.</p><p>Nobody was hurt, said the mayor on Tuesday evening.</p></article></body></html>', "Rain\n\nIt rained all day in the valley, and the river rose by a foot.\n\nNobody was hurt, said the mayor on Tuesday evening."),
    ('<html><body><div class="c7">Home News Sport</div><article><p>The team won by two goals to one, after a long game that was stopped twice.</p><p>It plays again on Sunday.</p></article>All rights reserved.</body></html>', "The team won by two goals to one, after a long game that was stopped twice.\n\nIt plays again on Sunday."),
    ('<html><body><div><p>The old mill was sold last week. Its new owner plans a hotel there, with forty rooms and a garden.</p><p>Work begins in May, if the town agrees to it.</p></div>All rights reserved.</body></html>', "The old mill was sold last week. Its new owner plans a hotel there, with forty rooms and a garden.\n\nWork begins in May, if the town agrees to it."),
    ('<html><body><article><h1>Wald</h1><p>Der Wald ist alt, und viele Wege sind gesperrt, seit der Sturm im Herbst kam.</p><p>Im Sommer soll alles wieder offen sein.</p></article><div class="fuss">Impressum | Datenschutz</div></body></html>', "Wald\n\nDer Wald ist alt, und viele Wege sind gesperrt, seit der Sturm im Herbst kam.\n\nIm Sommer soll alles wieder offen sein."),
    ('<html><body><article><header><h1>Bees</h1><p>By Ann</p></header><p>Bees came back to the park this spring, after three years away.</p><p>The hives stand by the pond.</p><footer>Filed under nature</footer></article></body></html>', "Bees\n\nBees came back to the park this spring, after three years away.\n\nThe hives stand by the pond."),
]


@pytest.mark.parametrize("i", range(len(PLAIN_PAGES)))
def test_html_plain_names(i):
    page, text = PLAIN_PAGES[i]
    assert html_extract.extract_all([page], html_extract.trained()) == [text]


def test_html_known_pages():
    got = html_extract.extract_all([s for s, _ in KNOWN_PAGES], html_extract.trained())
    assert [t.split("\n\n") for t in got] == [want for _, want in KNOWN_PAGES]


def test_html_held_out():
    model = html_extract.trained()
    pairs = list(html_extract.training_pages(200, 77))
    right = sum(t == "\n\n".join(b) for t, (_, b) in zip(html_extract.extract_all([s for s, _ in pairs], model), pairs, strict=True))
    assert right / len(pairs) > 0.9


def test_decoding_never_contradicts():
    page = html_extract.Page("<div><p>a</p><div><p>b</p></div></div><div><p>c</p></div>")
    rng = np.random.default_rng(5)
    for _ in range(50):
        kept = page.decode(rng.random(len(page.tag)))
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])
