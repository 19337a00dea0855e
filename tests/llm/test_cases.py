"""Awkward cases of language identification, encoding, components and the pipeline's stages; the decoder of the codes by brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import bpe, components, decontaminate, entry, langid, line_dedup

CLASH = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, ambiguous string, token_ids string, decoded string, text_sha256 string, keep_id string, item_id string, line string, n_lines string"
EN, DE = "the cat sat on the mat and looked at the other cats of the house", "der hund und die katze sind in dem haus und sehen die anderen hunde"


def table(spark, rows):
    """Rows of (doc_id, text, lang), with columns named as those that operators add."""
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), *"abcdefghij") for r in rows], CLASH)


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(table(spark, [(i, t, lang) for i in range(6) for t, lang in ((EN, "en"), (DE, "de"))]))


def test_language_cases(spark, model):
    rows = [(1, EN, None), (1, EN, None), (2, None, "en"), (3, "", None), (None, DE, None), (4, "1234 !", None), (5, DE * 3_000, None)]
    df = table(spark, rows)
    got = langid.identify(df, model)
    assert got.columns == [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")] + ["lang_pred", "score", "ambiguous"]
    said = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()), key=str)
    assert [(i, p) for i, p, _ in said] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "de")] and said[0] == said[1] and all(0 <= s <= 1 for _, _, s in said)
    assert langid.identify(df.limit(0), model).collect() == []
    own = langid.identify(df, model, prefix="_tl_")
    assert own.columns == [*df.columns, "_tl_lang_pred", "_tl_score", "_tl_ambiguous"] and {r["lang_pred"] for r in own.collect()} == {"a"}
    nothing = langid.fit(df.limit(0))
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}


def test_decoding_by_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 4, 7):
        m = langid.Model([f"l{i}" for i in range(n)], rng.integers(0, 40, (n, langid.BUCKETS)).astype(float))
        margins = rng.normal(0, 3, (20, m.codes.shape[1]))
        best, score, lead = m.decode(margins)
        for i, row in enumerate(margins):
            loss = [sum(w * math.log1p(math.exp(-x * c)) for x, c, w in zip(row, m.codes[k], m.sure[k], strict=True)) for k in range(n)]
            p = [math.exp(min(loss) - v) for v in loss]
            p = sorted((v / sum(p), k) for k, v in enumerate(p))
            assert best[i] == p[-1][1] and abs(score[i] - p[-1][0]) < 1e-9 and abs(lead[i] - (p[-1][0] - (p[-2][0] if n > 1 else 0))) < 1e-9


def test_encoding_cases(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(entry.TOKENIZER)
    lib = Tokenizer.from_file(path)
    rows = [(1, "Some words, twice.", None), (1, "Some words, twice.", None), (2, None, None), (3, "", None), (None, "é ß 漢字\n\n x", None), (4, "long words " * 8_000, None)]
    df = table(spark, rows)
    got = bpe.encode_decode(df, path)
    assert got.columns == [c for c in df.columns if c not in ("token_ids", "decoded")] + ["token_ids", "decoded"]
    want = sorted((str(i), np.array(ids := lib.encode(t or "", add_special_tokens=False).ids, np.uint32).tobytes().hex(), lib.decode(ids, skip_special_tokens=False)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), bytes(r["token_ids"]).hex(), r["decoded"]) for r in got.collect()) == want
    assert bpe.encode_decode(df.limit(0), path).collect() == []


def test_components_of_nulls_and_loops(spark):
    kind = "u long, v long"
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (5, 4), (4, 9), (None, 7), (8, None)], kind)
    # a link with a null end says nothing; a node linked to itself alone has no link
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {2: 2, 3: 2, 4: 4, 5: 4, 9: 4}
    assert components.components(edges.limit(0)).collect() == []


def test_lines_with_clashing_columns(spark):
    df = table(spark, [(i, "shared\nown", None) for i in range(3)])
    assert sorted(r["text"] for r in line_dedup.remove_boilerplate(df).collect()) == ["shared\nown"] * 3
    assert line_dedup.remove_boilerplate(df.limit(0)).collect() == []


def test_lines_that_share_a_hash(spark, monkeypatch):
    # a hash of the length alone: only the text that is on many sites goes
    monkeypatch.setattr(line_dedup, "_key", lambda line: F.length(F.btrim(line, F.lit(" \t\r"))).cast("long"))
    rows = [(i, f"often\nonce{'abcdefghijkl'[i]}", f"s{i}") for i in range(12)] + [(20, "never", "s1"), (21, " often", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(df).collect()}
    assert got == {i: t.split("\n")[1] for i, t, _ in rows[:12]} | {20: "never", 21: ""}


def test_leaks_with_clashing_columns(spark):
    df = table(spark, [(1, "Plain words without any slot stand here in a row for all of us.", None), (2, "nothing", None)])
    items = spark.createDataFrame([(7, "Plain words without any slot stand here in a row for all of us.", "x", "y")], "item_id long, text string, value string, doc_id string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, items).collect()] == [(1, 7)]
    assert decontaminate.keep_clean(df, items).columns == df.columns and [r["doc_id"] for r in decontaminate.keep_clean(df, items).collect()] == [2]


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, EN, "en"), (1, EN, "en"), (2, None, None), (3, "", None), (None, DE, "de"), (4, "word " * 20_000, "en"), (5, DE + " ende", "de")]
    df = table(spark, rows)
    got = stage(spark, df, DATA)
    found = got.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == df.columns
    texts = sorted(r["text"] or "" for r in found) if "text" in got.columns else None
    want = {
        "language_id": sorted([EN, EN, DE, "word " * 20_000, DE + " ende"]),
        "exact_dedup": sorted([EN, "", DE, "word " * 20_000, DE + " ende"]),
        "minhash": sorted([EN, "", "", DE, "word " * 20_000]),
        "decontaminate": sorted(t or "" for _, t, _ in rows),
    }
    if name == "minhash":
        # of a class one row stays: equal rows, and a text with one word more
        assert len(texts) in (5, 6) and {EN, "word " * 20_000} <= set(texts) and texts.count(EN) == 1
    elif texts is not None:
        assert texts == want[name]
    else:
        assert len(found) == len(rows)
    assert stage(spark, df.limit(0), DATA).collect() == []


def test_leaf_digests_are_the_hashes_of_fields(spark):
    from tallyloom.llm import merkle

    df = table(spark, [(1, "a", None)])
    assert df.select(merkle.leaf(df["doc_id"], df["lang"], df["text"])).first()[0] == hashlib.sha256(b"1:1-1:a").hexdigest()
