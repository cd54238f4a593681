"""Merkle manifest, hard negatives and chosen-path groups against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chosen_path, merkle, negatives
from gaugeworks.llm.queries import QUERIES

from . import brute

FOLDER = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows, fan):
    """rows: (key, id, leaf, received leaf); list of (key, id, leaf, subroot, root, proof, folded root)."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha(*below[i : i + fan]) for i in range(0, len(below), fan)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            lo = at // fan * fan
            yield level[lo:at], level[at + 1 : lo + fan]
            at //= fan

    low = lambda v: (v is not None, v)
    keys = sorted({r[0] for r in rows}, key=low)
    groups = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (low(r[1]), r[2])) for k in keys}
    trees = {k: tree([r[2] for r in g]) for k, g in groups.items()}
    upper = tree([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, (_, doc, leaf, got) in enumerate(groups[k]):
            steps = [*way(trees[k], i), *way(upper, n)]
            digest = got
            for left, right in steps:
                digest = sha(*left, digest, *right)
            proof = sha(*(x for left, right in steps for x in left + right))
            out.append((k, doc, leaf, trees[k][-1][0], upper[-1][0], proof, digest))
    return out


@pytest.mark.parametrize("fan, levels", [(8, 4), (2, 1), (3, 2), (2, 3)])
def test_manifest(spark, fan, levels):
    rng = random.Random(fan * 10 + levels)
    rows = [(f"k{k}", i, f"text {rng.random()}") for k, n in enumerate([1, 2, 9, 40, 65]) for i in range(n)]
    rows += [(None, i, "A null key") for i in (5, 3)] + [("k9", None, "x"), ("k9", 1, None), ("k9", 1, None), ("é", 1, ""), ("Z", 7, "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit("mine") for c in ("key", "node", "pos", "n", "path", "root", "sub", "id", "got", "part", "row")})
    fields = [F.col("doc_id"), F.col("lang")]
    changed = F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    got = merkle.manifest(df, "doc_id", "lang", merkle.leaf(*fields, F.col("text")), merkle.leaf(*fields, changed), fan, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    make = lambda k, i, t: sha(field(i), field(k), field(t))
    plain = [(k, i, make(k, i, t), make(k, i, t.upper() if t and i is not None and i % 3 == 0 else t)) for k, i, t in rows]
    want = [(i, leaf, sub, root, proof, folded, folded == root) for _, i, leaf, sub, root, proof, folded in plain_manifest(plain, fan)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([("a", 7, "t")], "lang string, doc_id long, text string")
    leaf = merkle.leaf(F.col("doc_id"), F.col("text"))
    assert merkle.manifest(df.limit(0), "doc_id", "lang", leaf, leaf).count() == 0
    r = merkle.manifest(df, "doc_id", "lang", leaf, leaf).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:7", "1:t") and r.proof_sha256 == sha("") and r.verified


def test_manifest_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    low = str.maketrans(merkle.A_Z, merkle.A_Z.lower())
    rows = []
    for r in docs:
        fields = [field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")]
        tampered = r.text.translate(low) if r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else r.text
        rows.append((r.lang, r.doc_id, sha(*fields, field(r.text)), sha(*fields, field(tampered))))
    want = [(i, leaf, sub, root, proof, folded, folded == root) for _, i, leaf, sub, root, proof, folded in plain_manifest(rows, 8)]
    assert sorted(map(tuple, QUERIES["op11_merkle_manifest"](spark, FOLDER).collect())) == sorted(want)


def plain_negatives(rows, is_anchor, k=5, best=3, low=50, high=95):
    rows = sorted({(i, str(label), tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None})
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), 1 - 2**63), 2**63 - 1)
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            hits = [(j, -t) for t, j, m in scored if m != label and low * -s <= 100 * -t <= high * -s][:best]
            out += [(i, p, rank + 1, j, -s, t) for rank, (j, t) in enumerate(hits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).collect())


@pytest.mark.parametrize("block, part, dims", [(8192, 8192, 8), (7, 3, 70), (20, 100, 1)])
def test_hard_negatives(spark, monkeypatch, block, part, dims):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PART", part)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(4, dims)) * 40
    rows = [(i, int(i % 4 if i % 7 else (i + 1) % 4), (centres[i % 4] + rng.normal(size=dims) * 30 + 20).astype(int).tolist()) for i in range(90)]
    rows += [(500 + i, i % 3, rows[1][2]) for i in range(20)]  # copies of one vector
    rows += [rows[0], rows[5], (5, 3, rows[7][2]), (600, None, rows[1][2]), (605, 1, None), (None, 1, rows[1][2]), (610, 1, [0] * dims), (615, 2, rows[3][2][: dims // 2]), (620, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").repartition(3)
    df = df.withColumns({c: F.lit("mine") for c in ("row", "block", "part", "rank", "place", "v", "id", "found")})
    want = plain_negatives([(i, m, [*v, *[0] * (dims - len(v))] if v is not None else None) for i, m, v in rows], lambda i: i % 5 == 0)
    got = mined(df)
    assert got == want and len(got) > 50
    assert mined(df.limit(0)) == []


def test_large_and_odd_components(spark):
    rows = [(i, i % 2, [float(x) for x in v]) for i, v in enumerate([(1e7, 1), (1e7, 2), (9e6, 0), (5e6, 1e7), (1e300, 1), (-1e300, -1), (1e300, 5), (0, 0)])]
    rows += [(20, 0, [float("nan"), 1.0]), (25, 1, [float("inf"), 1.0]), (30, 0, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<double>").select("vec_id", "label", negatives.quantised(F.col("x")).alias("vector"))
    whole = lambda x: min(max(int(np.floor(256 * x)), -(2**63)), 2**63 - 1) if abs(x) < 1e18 else (2**63 - 1 if x > 0 else -(2**63))
    want = plain_negatives([(i, m, [whole(x) for x in v]) for i, m, v in rows[:8]], lambda i: i % 5 == 0)
    assert mined(df) == want and want


@pytest.mark.parametrize("seed", range(4))
def test_intervals_hold_every_score(seed):
    rng = np.random.default_rng(seed)
    dims = [3, 64, 100, 200][seed]
    rows = (rng.normal(size=(300, dims)) * rng.choice([1, 300, 1e6])).astype(np.int64)
    rows[0] = 0
    codes = negatives.Codes.of(rows)
    share = []
    for q in [*(rng.normal(size=(20, dims)) * 100).astype(np.int64), rows[5], rows[0]]:
        low, high = codes.interval(negatives.rotated(q[None, :])[0], slice(None))
        exact = rows @ q
        assert (low <= exact).all() and (exact <= high).all()
        share.append(((high - low) / (2 * np.linalg.norm(rows, axis=1) * np.linalg.norm(q) + 1)).mean())
    assert np.mean(share) < 0.75  # the intervals are narrower than plain Cauchy-Schwarz
    assert (negatives.products(rows, rows[7]) == rows @ rows[7]).all()


def near(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_groups(df, **kw).collect()}


@pytest.mark.parametrize("limit, rows, pivots", [(2048, 4096, 8), (6, 8, 2)])
def test_chosen_path_groups(spark, frame, texts, monkeypatch, limit, rows, pivots):
    monkeypatch.setattr(chosen_path, "LIMIT", limit)
    monkeypatch.setattr(chosen_path, "ROWS", rows)
    monkeypatch.setattr(chosen_path, "PIVOTS", pivots)
    monkeypatch.setattr(chosen_path, "_CELLS", 500)
    monkeypatch.setattr(chosen_path, "_PIECE", 3000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    more = []
    for i in range(60):  # one group whose members lie around the threshold of each other
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        more.append((1000 + i, " ".join(w)))
    rows = texts + more
    want = brute.groups(rows, 80, 2)
    got = near(frame(rows))
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 50


def test_chosen_path_cases(spark, frame):
    out = chosen_path.near_groups(frame([(3, "a b c"), (1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (5, ""), (6, None), (7, "a"), (8, "A"), (9, "b")]))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=repr)
    assert got == sorted([(3, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True)], key=repr)
    assert chosen_path.near_groups(frame([])).count() == 0


def test_chosen_path_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = brute.groups(docs, 80, 2)
    rows = QUERIES["op13_minhash_near_dedup"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_odd_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(300):
        base = rng.integers(0, 2**62, rng.integers(1, 400)).astype(np.uint64)
        for share in (1.0, 0.95, 0.9, 0.8):
            kept = base[rng.random(len(base)) < share]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**62, max(0, len(base) - len(kept)) // 2).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    i = np.repeat(np.arange(0, len(sets) - 4), 4)
    j = i + np.tile(np.arange(1, 5), len(sets) - 4)
    for bits in (0.75, 6.0):
        known = chosen_path.Sketches([chosen_path.odd_sketch(s, bits) for s in sets], np.array([len(s) for s in sets]))
        p, q, _ = known.passing(i, j, 80)
        passed = set(zip(p.tolist(), q.tolist()))
        links = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))}
        assert links <= passed and len(links) > 100
        assert len(passed) < len(links) * (2 if bits < 1 else 1.2)


def test_trees_miss_next_to_nothing():
    assert chosen_path.miss(0.8, 2, 80) < 1e-5 and chosen_path.miss(0.8, 5, 80) < 1e-3
    # Measured: sets of similarity 0.8 share a node after two steps in all but a few of many tries.
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(150):
        common, a, b = (rng.integers(0, 2**62, n).astype(np.uint64) for n in (80, 10, 10))
        x, y = (chosen_path.descend(chosen_path.roots(), np.concatenate([common, z]), 2, 80) for z in (a, b))
        met += bool(np.intersect1d(x, y).size)
    assert met >= 149
