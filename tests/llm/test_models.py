"""Language identification, language model, fingerprints and search against brute force or held-out accuracy."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import elias_fano, fm_index, langid, ngram_lm, spots, topk, words
from gaugeworks.llm.queries import QUERIES
from gaugeworks.operators.lineage import cut as real_cut

from . import brute

FOLDER = "/root/testdata/sf0.001"


def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_language_held_out(spark):
    rows, labels = QUERIES["op4_language_id"](spark, FOLDER).collect(), docs(spark)
    assert len(rows) == len(labels)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == labels[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def ppm_bits(train, text):
    """Code length of a text by plain escape coding over the contexts of the training texts."""
    counts = {}
    for t in train:
        raw = bytes(langid.ORDER) + t.lower().encode()
        for i in range(langid.ORDER, len(raw)):
            for k in range(langid.ORDER + 1):
                counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    raw, bits = bytes(langid.ORDER) + text.lower().encode(), 0.0
    for i in range(langid.ORDER, len(raw)):
        for k in range(langid.ORDER, -1, -1):
            c = counts.get(raw[i - k : i])
            if c is None:
                continue
            both = sum(c.values()) + len(c)
            if raw[i] in c:
                bits += math.log2(both / c[raw[i]])
                break
            bits += math.log2(both / len(c))
        else:
            bits += 8
    return bits


def test_language_code_lengths_and_cases(spark, frame, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 64)
    train = [("aa", "the thing is on the hill and the mill"), ("aa", "then the hen"), ("bb", "le chat est sur la table été"), (None, "zzz"), ("bb", None)]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, lang string, text string"), "doc_id", "text", "lang")
    assert model.languages == ["aa", "bb"]
    tests = ["the hill", "été sur le chat", "quite other wörds " * 20, "x"]
    got = model.bits(tests)
    for row, text in zip(got, tests, strict=True):
        want = [ppm_bits([t for name, t in train if name == lang and t], text) for lang in model.languages]
        assert np.allclose(row, want, rtol=1e-4)
    cases = [(1, None), (2, ""), (3, "!! 12"), (4, "the hill"), (5, "été" * 3000), (5, "été" * 3000)]
    rows = frame(cases).select("doc_id", "lang", langid.predict(spark, F.col("text"), model).alias("p")).collect()
    assert {r["doc_id"]: r["p"]["lang"] for r in rows} == {1: "und", 2: "und", 3: "und", 4: "aa", 5: "bb"} and len(rows) == 6
    none = langid.fit(spark.createDataFrame([], "doc_id long, lang string, text string"), "doc_id", "text", "lang")
    assert [r[0]["lang"] for r in frame(cases).select(langid.predict(spark, F.col("text"), none)).collect()] == ["und"] * 6


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 5), (900, 1 << 20), (3000, 1 << 60), (5000, 6000)):
        v = np.unique(rng.integers(0, universe, n)).astype(np.uint64) if n else np.empty(0, np.uint64)
        e = elias_fano.EliasFano(elias_fano.build(v, universe))
        if len(v):
            assert (e.get(np.arange(len(v))) == v).all()
        asked = np.r_[v, rng.integers(0, universe, 500).astype(np.uint64)]
        where = {int(x): i for i, x in enumerate(v)}
        assert e.find(asked).tolist() == [where.get(int(x), -1) for x in asked]


def test_fm_index():
    rng = np.random.default_rng(1)
    for kinds in (2, 3, 9, 40):
        s = np.r_[0, rng.integers(0, kinds, 400), 0]
        index = fm_index.FMIndex(s, kinds, 5)
        starts = np.array([i for i in range(len(s) - 4) if (s[i : i + 4] > 0).all()])
        lo, hi = index.search(s, starts, 4)
        for i, a, b in zip(starts, lo, hi, strict=True):
            want = {j for j in range(len(s) - 3) if (s[j : j + 4] == s[i : i + 4]).all()}
            assert set(index.order[a:b].tolist()) == want


def lm_brute(train, texts, smooth):
    tok = lambda t: [*brute.words(t, True), None]
    c, pairs, contexts = Counter(), Counter(), Counter()
    for t in train:
        w = tok(t)
        c.update(w)
        pairs.update(zip(["begin", *w], w))
        contexts.update(["begin", *w[:-1]])
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    for t in texts:
        w = tok(t)
        base = sum(math.log10(p(x)) for x in w)
        yield n, len(w), sum(x in c for x in w), base, sum(math.log10((pairs[a, b] + smooth * p(b)) / (contexts[a] + smooth)) for a, b in zip(["begin", *w], w))


def test_ngram_scores_query(spark):
    d = docs(spark)
    rows = QUERIES["op10_ngram_scores"](spark, FOLDER).collect()
    train = [x["text"] for k, x in d.items() if brute.crc(k) % 10]
    want = dict(zip(d, lm_brute(train, [x["text"] for x in d.values()], 200.0), strict=True))
    assert len(rows) == len(d)
    for r in rows:
        n, tokens, known, base, score = want[r["doc_id"]]
        assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["held_out"]) == (n, tokens, known, brute.crc(r["doc_id"]) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and abs(r["score"] - score) <= 0.0003 * tokens
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_ngram_cases(frame, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", 50)
    cases = [(1, None), (2, ""), (3, "The the thing"), (4, "unknown words"), (4, "unknown words"), (None, "the " * 5000)]
    train = ["the thing is", "the thing", "", None]
    model = ngram_lm.train(frame(enumerate(train)), smooth=3.0)
    rows = frame(cases).select("doc_id", "text", "score", ngram_lm.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == 6 and all(r["score"] == "mine" for r in rows)
    for r in rows:
        _, tokens, known, base, score = next(lm_brute(train, [r["text"]], 3.0))
        assert (r["s"]["n_tokens"], r["s"]["n_known"]) == (tokens, known)
        assert math.isclose(r["s"]["base_score"], base, rel_tol=1e-9) and abs(r["s"]["score"] - score) <= 0.0003 * tokens
    empty = ngram_lm.train(frame([]))
    assert {(r[0]["n_known"], r[0]["score"]) for r in frame(cases).select(ngram_lm.score(F.col("text"), empty)).collect()} == {(0, 0.0)}
    assert frame([]).select(ngram_lm.score(F.col("text"), model)).count() == 0


def edited(text, following):
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def check_spots(rows, pairs):
    assert len(rows) == len(pairs)
    for doc_id, text, following in pairs:
        r = rows[doc_id]
        assert r["edited_sha256"] == hashlib.sha256(edited(text, following).encode()).hexdigest() and r["n_chars"] == len(text)
        sets = [{r[c][i : i + 8] for i in range(0, len(r[c]), 8)} for c in ("fingerprint", "edited_fingerprint")]
        want = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
        assert math.isclose(r["near_edited"], want)


def test_spots_query(spark):
    d = sorted((k, r["text"]) for k, r in docs(spark).items())
    rows = {r["doc_id"]: r for r in QUERIES["op6_spot_signatures"](spark, FOLDER).collect()}
    check_spots(rows, [(k, t, d[(i + 1) % len(d)][1]) for i, (k, t) in enumerate(d)])
    prints = {}
    for k, t in d:
        assert prints.setdefault(t, rows[k]["fingerprint"]) == rows[k]["fingerprint"]
    long = [rows[k] for k, t in d if len(t.split()) > 30 and len(set(t.split())) > 20]
    assert sum(r["near_edited"] > 0.3 for r in long) > 0.95 * len(long) and sum(r["near_next"] < 0.3 for r in long) > 0.95 * len(long)


@pytest.mark.parametrize("bucket", [500, 3])
def test_next_row(frame, texts, monkeypatch, bucket):
    monkeypatch.setattr(spots, "BUCKET_ROWS", bucket)
    rows = [(3 * i, t) for i, t in texts] + [(None, "no id"), (None, None)]
    got = spots.with_next(frame(rows), "doc_id", {"text": "following", "n": "rank"}).collect()
    assert len(got) == len(rows) and all(r["rank"] == "mine" for r in got if r["doc_id"] is not None)
    known = {r["doc_id"]: r["following"] for r in got if r["doc_id"] is not None}
    assert known == {3 * i: texts[(i + 1) % len(texts)][1] for i, _ in texts}
    assert [r["following"] for r in got if r["doc_id"] is None] == [None, None]
    assert spots.with_next(frame([]), "doc_id", {"text": "following"}).count() == 0


def test_signature_cases(frame):
    cases = {1: None, 2: "", 3: "!!!", 4: "one", 5: "the red fox and a blue hen", 6: "red blue green white", 7: "the red fox and a blue hen"}
    sizes = {r["doc_id"]: len(r["s"]) for r in frame(cases.items()).select("doc_id", spots.signatures(F.col("text")).alias("s")).collect()}
    assert sizes == {1: 0, 2: 0, 3: 1, 4: 1, 5: 3, 6: 2, 7: 3}


def test_near_fingerprints(frame, texts):
    df = frame(texts).select("doc_id", spots.signatures(F.col("text")).alias("sig"))
    sets = {r["doc_id"]: frozenset(r["sig"]) for r in df.collect() if r["sig"]}
    pairs, members = spots.near_pairs(df, "doc_id", "sig", 0.6)
    of = {r["id"]: r["set_id"] for r in members.collect()}
    got = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    want = {frozenset((of[a], of[b])) for a in sets for b in sets if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got == want and want


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    return df.select("*", topk.quantise(F.col("embedding")).alias("vector"))


@pytest.mark.parametrize("few", [1, 40])
def test_topk(spark, monkeypatch, few):
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = np.random.default_rng(few)
    x = rng.normal(0, 0.3, (400, 12)).astype("f4")
    x[100:200] = x[100]  # a large group of ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [None, 1.0]), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (None, [1.0]), (1005, []), (1006, [0.5])]
    df = vectors(spark, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id % 20 = 0"), few).collect())
    q = {i: np.floor(np.r_[np.array(v, float), np.zeros(12 - len(v))] * 256).astype(int) for i, v in rows if i is not None and i not in (1000, 1001, 1002, 1003)}
    want = []
    for a in q:
        if a % 20 == 0:
            ranked = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:few]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(ranked)]
    assert got == sorted(want)


def test_topk_stops_only_on_proof():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (500, 6))
    block = topk.Block(np.arange(500), rows)
    for _ in range(20):
        q = rng.integers(-80, 80, 6)
        best = set(np.argsort(-(rows @ q), kind="stable")[:5].tolist())
        found = block.candidates(q, 5)
        assert best <= set(found.tolist()) and len(found) < 500


def test_topk_few_and_none(spark):
    df = vectors(spark, [(0, [1.0]), (20, [1.0]), (20, [1.0])])
    assert len(topk.search(df, df.where("vec_id = 0"), 5).collect()) == 2
    assert topk.search(df.limit(0), df, 5).count() == 0 and topk.search(df, df.limit(0), 5).count() == 0


def test_word_hashes(texts):
    some = [t for _, t in texts]
    got = [(lo, h, c) for lo, h, c in words.grouped(some, True, size=500)]
    hashes, counts = np.concatenate([h for _, h, _ in got]), np.concatenate([c for *_, c in got])
    want = [brute.words(t, True) for t in some]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_language_sample_is_sifted_before_it_is_shuffled(spark, monkeypatch):
    long = "un texte assez long pour être appris " * 4000
    rows = [(i, "aa", f"the thing is on the hill number {i}") for i in range(300)] + [(1000, "bb", long)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    seen = []
    monkeypatch.setattr(langid, "cut", lambda f: (seen.append(f), real_cut(f))[1])
    model = langid.fit(df, "doc_id", "text", "lang", sample_rows=20, sample_chars=1000)
    assert model.languages == ["aa", "bb"]  # a language of long texts only is learnt from their beginnings
    plan = seen[1]._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Window") :]
    assert "BroadcastHashJoin" in plan and before.index("Exchange hashpartitioning(lang") < before.index("BroadcastHashJoin")
    monkeypatch.setattr(langid, "MODEL_GRAMS", 3)
    with pytest.raises(ValueError, match="larger than its bound"):
        langid.fit(df, "doc_id", "text", "lang")


def test_search_takes_large_and_odd_components(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(1e7, 1), (1e7, 2), (-9e6, 0), (5e6, 1e7), (1e300, 1), (-1e300, -1), (0, 0), (1, 1)])]
    rows += [(20, [float("nan"), 1.0]), (21, [None, 1.0]), (22, None)]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>").select("vec_id", topk.quantise(F.col("x")).alias("vector"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id < 3"), 3).collect())
    whole = lambda x: min(max(int(np.floor(256 * x)), -(2**63)), 2**63 - 1) if abs(x) < 1e18 else (2**63 - 1 if x > 0 else -(2**63))
    exact = {i: [whole(x) for x in v] for i, v in rows[:8]}
    want = []
    for q in range(3):
        scored = sorted((-min(max(sum(a * b for a, b in zip(exact[q], exact[i])), 1 - 2**63), 2**63 - 1), i) for i in exact if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3])]
    assert got == want


def murmur(raw):
    """Spark's hash of a text: murmur3, bytes beyond the last whole word one by one."""
    m32 = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m32

    def step(h, k):
        k = rot((k * 0xCC9E2D51) & m32, 15) * 0x1B873593 & m32
        return (rot(h ^ k, 13) * 5 + 0xE6546B64) & m32

    h, whole = 42, len(raw) // 4 * 4
    for i in range(0, whole, 4):
        h = step(h, int.from_bytes(raw[i : i + 4], "little"))
    for b in raw[whole:]:
        h = step(h, (b - 256 if b > 127 else b) & m32)
    h ^= len(raw)
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m32
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & m32
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def plain_signature(text):
    import regex

    words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split(" ")
    words = [w for w in words if w]
    common, found = set(spots.ANCHORS), set()
    for i, w in enumerate(words):
        behind = words[i + 1 :][: 200 if w in common else spots.CHAIN]
        content = [x for x in behind if x not in common][: spots.CHAIN]
        if len(content) == spots.CHAIN and (w in common or content == behind):
            found.add(murmur(" ".join([w, *content]).encode()))
    if not found and words:
        found = {murmur(" ".join(words).encode())}
    if not found and text:
        found = {murmur(text.encode())}
    return sorted(found)


ODD_SPOTS = ["the of and", "the cat of", "a b", "the the the cat the dog the", "cat dog of the", " the cat sat of ", "the cat the " * 9, "of " * 50 + "cat " * 3 + "the " * 9, "a1 the-cat's (dog) of\tthe bird\nfish", "one\ttwo\nthree"]


def test_fingerprints_by_a_plain_loop(spark):
    from .conftest import sample_texts

    rows = [t for t in sample_texts() + ODD_SPOTS if t is None or "İ" not in t]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, text string").repartition(3)
    following = "the bird of a tree sings and the fish swims in deep water " * 3
    df = df.withColumn("edited", spots.edited(F.col("text"), F.lit(following)))
    got = df.select("text", "edited", spots.signatures(F.col("text")).alias("a"), spots.signatures(F.col("edited")).alias("c")).collect()
    for r in got:
        k = len(r.text or "") // 4
        assert r.edited == (r.text or "")[: len(r.text or "") - k] + following[:k]
        assert r.a == plain_signature(r.text), r.text
        assert r.c == plain_signature(r.edited), r.edited


def test_fingerprint_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op6_spot_signatures"](spark, FOLDER).collect()}
    texts = {k: r["text"] or "" for k, r in docs(spark).items()}
    order = sorted(texts)
    as_text = lambda s: "".join(f"{x & 0xFFFFFFFF:08X}" for x in s)
    like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    for at, k in enumerate(order):
        text, after = texts[k], texts[order[(at + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, new, other = plain_signature(text), plain_signature(edited), plain_signature(after)
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(own), as_text(new))
        assert r["near_edited"] == pytest.approx(like(own, new)) and r["near_next"] == pytest.approx(like(own, other))
