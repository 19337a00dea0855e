"""Centroid clustering, the Merkle manifest and Golay fuzzy hashing against brute force, with the awkward cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import entry, golay_simhash, merkle, sort_means

DATA = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ sort-means

VECTORS = "vec_id long, embedding array<double>, cluster string, v int, n int"


def brute_lloyd(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"1:{kept[r][0]}".encode()).hexdigest() if kept[r][0] is not None else "", kept[r][1]))
    cents = [kept[r][1] for r in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), cents


def test_lloyd(spark):
    rng = random.Random(5)
    # few distinct values: many ties and equal vectors
    rows = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(7, [0.0] * 4), (7, [0.0] * 4), (0, [0.001, 1.0, 0.0, 0.0]), (0, [0.002, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (None, None), (1, []), (2, [0.0] * 3), (3, [0.0, None, 0.0, 0.0]), (4, [float("nan")] * 4), (5, [0.0, float("inf"), 0.0, 0.0]), (6, [-1e5, 1e5, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    for k, rounds in ((5, 0), (7, 3), (1, 2), (400, 2)):
        got, cents, inertia = sort_means.sort_means(df.repartition(5), k=k, rounds=rounds, dim=4)
        want, centroids = brute_lloyd(rows, k, rounds, 4)
        assert cents.tolist() == centroids
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got.collect()) == want
        assert sum(inertia) == sum(w[2] for w in want)


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    got, cents, inertia = sort_means.sort_means(df)
    assert got.collect() == [] and len(cents) == 0 and inertia == [] and [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint"]


def test_sort_means_scans_less_and_agrees():
    rng = np.random.default_rng(3)
    x, cents = rng.integers(-60, 60, (2000, 8)), rng.integers(-60, 60, (40, 8))
    full = ((x[:, None] - cents[None]) ** 2).sum(2)
    for last in (np.zeros(2000, np.int64), full.argmin(1), rng.integers(0, 40, 2000)):
        best, distance = sort_means.assign(x, last, cents)
        assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_components_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e30] * 4, "x", 1, 2)], VECTORS)
    with pytest.raises(Exception, match="would not fit"):
        sort_means.sort_means(df, dim=4)


# ------------------------------------------------------------------ Merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes):
    """The root, and of each leaf the siblings of all levels."""
    paths, at, level = [""] * len(nodes), list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i in range(len(nodes)):
            run = at[i] // 8
            paths[i] += "".join(h for j, h in enumerate(level[run * 8 : run * 8 + 8]) if run * 8 + j != at[i])
            at[i] = run
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 448, 511, 512])
def test_traversal(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, want = brute_tree(leaves)
    levels = merkle.height(n)
    got = list(merkle.traverse(leaves, levels))
    assert merkle.block_root(leaves, levels) == root
    assert ["".join(b + a for b, a in p) for p in got] == want


def test_manifest(spark):
    rng, rows = random.Random(2), []
    for group, n in ((None, 3), ("", 1), ("a", 1300), ("é", 9), ("z", 513), ("Z", 512)):
        rows += [(group, rng.randrange(10**6) if rng.random() > 0.01 else None, sha(f"{group}{rng.randrange(n)}"), "x") for _ in range(n)]
    rows += [("g%02d" % i, i, sha(str(i)), "x") for i in range(600)] + [("a", 5, sha("same"), "y")] * 40
    df = spark.createDataFrame(rows, "group string, id long, node string, path string").repartition(5)
    got = merkle.manifest(df.select("group", "id", "node", F.col("path").alias("tampered")), {"tampered": "string"})
    got = got.select("id", "node", "tampered", "subroot", "root", merkle.siblings(F.col("path")).alias("p"), merkle.fold(F.col("node"), F.col("path")).alias("f"))
    groups = sorted({r[0] for r in rows}, key=lambda g: b"" if g is None else b"." + g.encode())
    trees = {}
    for g in groups:
        mine = sorted((r[1:] for r in rows if r[0] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = (mine, *brute_tree([r[1] for r in mine]))
    root, above = brute_tree([trees[g][1] for g in groups])
    want = sorted((str(r[0]), r[1], r[2], trees[g][1], root, p + above[groups.index(g)], root) for g in groups for r, p in zip(trees[g][0], trees[g][2], strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_manifest_of_nothing_and_one(spark):
    kind = "group string, id long, node string"
    assert merkle.manifest(spark.createDataFrame([], kind)).collect() == []
    (row,) = merkle.manifest(spark.createDataFrame([(None, None, "ab")], kind)).collect()
    assert row["root"] == row["subroot"] == row["node"] == "ab" and row["path"] == []


def test_leaf(spark):
    df = spark.createDataFrame([(1, None, "é", "x" * 300_000), (None, "", None, None)], "a long, b string, c string, d string")
    got = [r[0] for r in df.select(merkle.leaf(*map(F.col, "abcd"))).collect()]
    assert got == [sha("1:1-2:é300000:" + "x" * 300_000), sha("-0:--")]


def test_proofs_of_documents(spark, tmp_path):
    rows = [(1, "Ab", "en", "s", 2), (2, "ab", "en", "s", 2), (3, None, "en", None, None), (None, "Q", None, "s", 1), (4, "X" * 90_000, "de", "s", 9), (4, "X" * 90_000, "de", "s", 9)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["verified"]) for r in entry.op12_merkle(spark, str(tmp_path)).collect()}
    import zlib

    assert got == {(r[0], not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and (r[1] or "") != (r[1] or "").lower())) for r in rows}


# ------------------------------------------------------------------ Golay fuzzy hashing


def brute_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows (id, fingerprint): the least id of each row's component."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in rows]


def test_golay_code_is_perfect():
    n = np.array([(p >= 0).sum() for p in golay_simhash._patterns()])
    assert sorted(set(n)) == [1, 6] and (n == 1).sum() == 1 + 23 + 253
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in ((), (3,), (0, 22), (7, 15)):
        other = words ^ sum(1 << f for f in flips)
        a, b = golay_simhash.codewords(words), golay_simhash.codewords(other)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("blocks", [3, 4])
def test_three_errors_share_a_cell(blocks):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)
    # also all three errors within one segment
    for i, bits in enumerate(itertools.combinations(range(22), 3)):
        b[i] = a[i] ^ np.uint64(sum(1 << (x + (0, 22, 42)[i % 3]) for x in bits))
    x, y = golay_simhash.cells(a, blocks), golay_simhash.cells(b, blocks)
    assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("most", [2, 6, 256])
def test_links_lose_nothing(spark, most):
    rng = random.Random(most)
    prints = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(12):
            prints.add(at)
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
    crowd = rng.getrandbits(64)
    prints |= {crowd ^ sum(1 << b for b in range(9) if rng.random() < 0.5) for _ in range(80)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {(r["u"], r["v"]) for r in golay_simhash.links(fps, most).collect()}
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 3 for u, v in got)
    root = {s: s for s in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for u, v in got:
        root[find(u)] = find(v)
    want = {(i, f): c for i, f, c in brute_components([(k, s & ((1 << 64) - 1)) for k, s in enumerate(signed)])}
    groups, wanted = {}, {}
    for k, s in enumerate(signed):
        groups.setdefault(find(s), set()).add(k)
        wanted.setdefault(want[(k, s & ((1 << 64) - 1))], set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(golay_simhash, "PIECE", 64)
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(9, None), (3, ""), (4, " \t\x0b\n"), (5, "one"), (5, "One"), (6, "one two"), (None, base), (11, base), (12, base.upper()), (13, base + " more"), (14, "né x Ünder a b"), (15, "long " * 60_000), (None, "alone here now"), (16, "X" * 100_000)]
    df = spark.createDataFrame([(*t, "f", 1) for t in texts], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in golay_simhash.near_duplicates(df).collect()), key=str)
    want = [(i, f"{f:016x}", c) for i, f, c in brute_components([(i, brute_print(t)) for i, t in texts])]
    assert got == sorted(want, key=str)
    assert golay_simhash.near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in entry.op13_golay_simhash(spark, DATA).collect()}
    assert got == {(i, f"{f:016x}", c) for i, f, c in brute_components([(i, brute_print(t)) for i, t in rows])}
