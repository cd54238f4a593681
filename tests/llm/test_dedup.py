"""Line, substring and near-duplicate operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chosen_path, graph, jaccard, lines, substrings

from . import brute


def judged_lines(df):
    m = lines.with_keep(df, lines.keep_bitmaps(df))
    return m.select("doc_id", F.size(lines.lines_of(F.col("text"))).alias("n"), lines.n_dropped(F.col("keep")).alias("d"), lines.kept_text(F.col("text"), F.col("keep")).alias("k"))


def test_lines(frame, texts):
    got = {r["doc_id"]: (r["n"], r["d"], r["k"]) for r in judged_lines(frame(texts)).collect()}
    want = brute.lines_kept(texts)
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_lines_null_ids_repeats_many_lines_empty(frame):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, line), (None, line), (None, line), (5, None)]
    got = sorted((r["doc_id"] or 0, r["n"], r["d"]) for r in judged_lines(frame(rows)).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (5, 1, 0)]  # two documents hold it
    many = "\n".join([line, *(f"line number {i} of this long text" for i in range(200)), line])
    rows = [(i, many) for i in range(4)]
    assert {r["doc_id"]: r["d"] for r in judged_lines(frame(rows)).collect()} == {0: 202, 1: 202, 2: 202, 3: 0}
    assert judged_lines(frame([])).count() == 0


def judged_words(df):
    out = substrings.with_spans(df, substrings.repeated_spans(df)).withColumn("k", substrings.kept(F.col("text"), F.col("spans")))
    return {(r["doc_id"], r["text"]): (r["n_words"], r["kept"]) for r in out.select("doc_id", "text", "k.n_words", "k.kept").collect()}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(frame, texts, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK", 300)
    monkeypatch.setattr(substrings, "SEARCH", 64)
    got = {k[0]: v for k, v in judged_words(frame(texts)).items()}
    assert got == brute.windows_removed(texts)


def test_substrings_null_ids_repeats_empty(frame):
    text = " ".join(f"w{i}" for i in range(20))
    got = judged_words(frame([(1, text), (1, text), (1, "other " + text), (2, "x " + text + " y"), (None, text), (3, None)]))
    assert got[1, text] == (20, text) and got[None, text] == (20, text) and got[1, "other " + text][1] == "other " + text
    assert got[2, "x " + text + " y"] == (22, "x y") and got[3, None] == (0, "")
    assert judged_words(frame([])) == {}


def test_segments_of_copies_are_held_once(spark):
    """Words of equal segments are written once a block, not once for each document."""
    text = " ".join(f"word{i}" for i in range(400))
    docs = spark.createDataFrame([(i, text, 0) for i in range(50)], "doc long, text string, t long").repartition(1)
    lists = spark.createDataFrame([(i, sorted({a for _, x, _, _ in substrings.anchored([text], 13) for a in x.astype(np.int64).tolist()})) for i in range(50)], "doc long, wanted array<bigint>").repartition(1)
    found = substrings.segments(docs, lists, spark.sparkContext.broadcast(np.zeros(0, np.uint64)), 13, 4)
    kept = found.where("shard IS NOT NULL").toPandas()
    assert found.where("doc IS NOT NULL").count() == 50 and len(kept) <= 4 * spark.sparkContext.defaultParallelism
    rows = substrings._unpacked(kept)
    assert set(rows["low"]) == {0} and set(rows["high"]) == {49} and sum(len(w.split()) - 12 for w in rows["words"]) == 388
    assert kept["words"].map(len).sum() < 50 * len(text) / 4


@pytest.mark.parametrize("frequent", [24, 1])
def test_near_groups(frame, texts, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", frequent)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 2000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(frame(texts)).collect()}
    want = brute.groups(texts)
    assert got == want and sum(k != v[1] for k, v in want.items()) > 5


@pytest.mark.parametrize("limit, rows", [(2048, 4096), (6, 4)])
def test_near_chain_and_large_group(frame, monkeypatch, limit, rows):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 2)
    monkeypatch.setattr(chosen_path, "LIMIT", limit)  # with small limits entries are dealt in blocks and tiles
    monkeypatch.setattr(chosen_path, "ROWS", rows)
    base = [f"w{i}" for i in range(300)]
    chain = []
    for i in range(40):  # neighbours are near, the ends are not
        base = base[:]
        base[(i * 37) % 300] = f"new{i}"
        base[(i * 53 + 7) % 300] = f"more{i}"
        chain.append((i + 10, " ".join(base)))
    passage = " ".join(f"p{i}" for i in range(60))
    apart = [(100 + i, passage + " " + " ".join(f"d{i}x{j}" for j in range(15 + i))) for i in range(30)]
    rows = chain + apart
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(frame(rows)).collect()}
    assert got == brute.groups(rows)


def test_near_nulls_and_empty(frame):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(frame([(1, None), (2, ""), (3, "a b"), (4, "A  b"), (4, "A  b"), (None, "a b")])).collect())
    assert got == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3)]
    assert jaccard.near_groups(frame([])).count() == 0


def test_entries_always_meet():
    """Sets that link share an entry whatever is frequent (checked on random sets)."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        keep = rng.random(len(x)) > rng.random() * 0.3
        y = np.unique(np.r_[x[keep], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + len(x) // 4))).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        frequent = np.unique(np.r_[x[rng.random(len(x)) < rng.random()], y[rng.random(len(y)) < 0.3]])
        if len(y) and 100 * both >= 75 * (len(x) + len(y) - both):
            ex, ey = jaccard.entries(x, frequent, 75), jaccard.entries(y, frequent, 75)
            assert np.intersect1d(ex[0], ey[0]).size or np.intersect1d(ex[1], ey[1]).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert all(got[i] == 1 for i in range(2, 31)) and all(got[i] == 100 for i in range(101, 140)) and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_fine_sketches_never_hide_a_link():
    rng = np.random.default_rng(3)
    for n in (64, 100, 127, 128, 500, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for kept, more in ((n, 0), (n, n // 3), (n * 3 // 4, 0), (n // 2, n), (0, n)):
            y = np.unique(np.concatenate([x[:kept], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            p, q = jaccard.fine_sketch(x), jaccard.fine_sketch(y)
            if q is not None:
                assert jaccard.most_shared(p, q) >= len(np.intersect1d(x, y))
    crowd = np.arange(1000, dtype=np.uint64) * np.uint64(1 << 20)  # all in one remainder
    assert jaccard.most_shared(jaccard.fine_sketch(crowd), jaccard.fine_sketch(crowd[:900])) >= 900
    assert jaccard.fine_sketch(crowd[:63]) is None


def test_wanted_texts_come_whole(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc", "string(id) AS text")
    wanted = spark.range(0, 7000, 7).selectExpr("id AS doc", "id AS a")
    for bits in (1 << 25, 1 << 15, 64):
        monkeypatch.setattr(jaccard, "MAP_BITS", bits)
        assert sorted(r["doc"] for r in jaccard._of(docs, wanted).collect()) == list(range(0, 5000, 7))
    assert jaccard._of(docs, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("part", [4096, 5])
def test_every_link_counts(frame, monkeypatch, part):
    """A crowd of near copies, pairs just at and below the limit, and a copy: links are counted between all sets of a class."""
    monkeypatch.setattr(chosen_path, "PART_ROWS", part)
    monkeypatch.setattr(chosen_path, "_STRIP", 3)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(24):
        w = base[:]
        for i in rng.choice(120, 1 + k // 6, replace=False):
            w[i] = f"c{k}x{i}"
        rows.append((k + 1, " ".join(w)))
    rows += [(50, rows[3][1]), (51, "alone " + " ".join(f"z{i}" for i in range(9))), (52, None)]
    sets = {k: brute.shingles(t) for k, t in rows}
    kinds = set(sets.values()) - {frozenset()}
    near = lambda s, o: s != o and 100 * len(s & o) >= 75 * len(s | o)
    want = {k: (v[1], sum(near(sets[k], o) for o in kinds)) for k, v in brute.groups(rows).items()}
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.near_groups(frame(rows)).collect()}
    assert got == want and max(n for _, n in want.values()) > 10 and len({n for _, n in want.values()}) > 4


def test_proposals_are_no_more_than_rows(spark):
    """Sets that pass the sketches with many others give a forest, and rows that passed, instead of all pairs."""
    sketch = [0] * 8
    rows = [(node, sid, 100, sketch, sid) for node in (1, 2) for sid in range(60)] + [(3, 5, 100, sketch, 9), (3, 6, 100, sketch, 9), (3, 7, 100, sketch, 8)]
    got = chosen_path._nodes_compared(spark.createDataFrame(rows, "node long, sid long, n long, sketch array<bigint>, label long"), 75).collect()
    assert len(got) < len(rows) and {r["node"] for r in got if r["y"] is not None} == {1, 2, 3}
    assert {i for r in got if r["node"] == 3 for i in (r["x"], r["y"])} - {None} == {5, 6, 7}


def test_components_take_few_rounds(spark, monkeypatch):
    """Chains, rings, hubs and repeated edges in any order; each round is one table, so few tables are written."""
    import random

    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: tables.append(1) or real(df))
    monkeypatch.setattr(graph, "HELD", 50)
    edges = [(i, i + 1) for i in range(600)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(5000, i) for i in range(2000, 2300)] * 2
    random.Random(2).shuffle(edges)
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(8), "a", "b").collect())
    want = dict.fromkeys(range(1, 601), 0) | dict.fromkeys(range(1001, 1050), 1000) | dict.fromkeys([*range(2001, 2300), 5000], 2000)
    assert got == want and len(tables) <= 10


def test_entries_of_the_same_sets_go_on_once(spark):
    rows = [(e, s, s // 10) for e in range(40) for s in (10, 11, 20, 30)] + [(50, s, s // 10) for s in (10, 11, 20)] + [(60, s, 1) for s in (10, 11)] + [(70, s, 1) for s in (10, 10, 11)]
    rows += [(80, s, s // 10) for s in (10, 10, 20)] + [(90, s, s // 10) for s in (10, 20, 20)]
    named = spark.createDataFrame(rows, "entry long, set long, label long")
    got = jaccard.open_entries(named.select("entry", "set"), named).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 4, 2), (50, 1, 3, 1), (80, 1, 3, 1), (90, 2, 3, 1)]


def test_entries_are_sorted_in_small_blocks(monkeypatch):
    """A task that holds 2**20 entries at a time takes an executor of small memory over its limit."""
    from types import SimpleNamespace

    import pandas as pd

    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 4000)
    met = SimpleNamespace(groupBy=lambda *k: SimpleNamespace(applyInPandas=lambda f, s: None))
    taken = []
    jaccard.filed(SimpleNamespace(mapInPandas=lambda f, s: taken.append(f) or met), SimpleNamespace(value=np.zeros(0, np.uint64)), 5, 75, 1)
    texts = pd.DataFrame({"text": [" ".join(f"w{i}x{j}" for j in range(204)) for i in range(200)]})
    blocks = [sum(len(x) for x in b["sets"]) // 8 for b in taken[0]([texts])]
    assert sum(blocks) == 200 * 51 and max(blocks) <= 1000 + 51


def test_words_of_a_shard_are_numbered_without_sorting(monkeypatch):
    """Sorting a shard's words as objects took a third of the search."""
    import pandas as pd

    def unique(x, *a, real=np.unique, **k):
        assert np.asarray(x).dtype != object
        return real(x, *a, **k)

    monkeypatch.setattr(np, "unique", unique)
    rows = pd.DataFrame({"words": [b"b a c a b", b"a c a b d", b"a c a"], "ka": [1, 2, 3], "kb": [4, 5, 6], "low": [7, 3, 9]})
    assert [x.tolist() for x in substrings.first_docs(rows, 3)["firsts"]] == [[7, 3, 3], [3, 3, 3], [3]]


def test_a_search_holds_few_bytes_a_word():
    """Two searches at a time, each holding all words of its shard as objects, took an executor over its memory."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(4)
    segments = [" ".join(f"word{k}" for k in rng.integers(0, 3000, 25)).encode() for _ in range(4000)]
    rows = pd.DataFrame({"words": segments, "ka": np.arange(4000), "kb": np.arange(4000), "low": np.arange(4000)})
    tracemalloc.start()
    out = substrings.first_docs(rows, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 4000 * 25 and all((x == k).all() for k, x in enumerate(out["firsts"]))


def test_pairs_of_an_entry_are_held_against_its_hub_or_go_on(spark, frame, texts, monkeypatch):
    """The one hub of an entry has no row: it was held against all others.  Any other two sets of an entry both have one."""
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 4000)
    docs = [*texts, *((500 + k, t) for k, t in texts[:12])]
    no = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    rows = frame(docs).selectExpr("doc_id AS doc", "text")
    found = [tuple(r) for r in jaccard.filed(rows, no, 5, 75, 3).select("entry", "set", "hub").collect()]
    held, judged, want = {}, set(), {}
    for e, s, h in found:
        held.setdefault(e, []).append((s, h))
        judged.add((e, min(s, h), max(s, h)))
    for _, s in jaccard.shingle_sets([t for _, t in docs], 5):
        if len(s):
            for e in np.concatenate(jaccard.entries(s, no.value, 75)).astype(np.int64).tolist():
                want.setdefault(e, set()).add(jaccard.set_hash(s)[0])
    want = {e: sorted(s) for e, s in want.items() if len(s) > 1}
    assert set(held) == set(want) and len(want) > 100
    for e, sets in want.items():
        on = {s for s, _ in held[e]}
        assert all((x in on and y in on) or (e, x, y) in judged for i, x in enumerate(sets) for y in sets[i + 1 :])
        hubs = {h for _, h in held[e]}
        assert len(hubs) > 1 or hubs.isdisjoint(on)


def test_rows_stay_where_no_node_is_large(spark):
    """Each look for rows of large nodes wrote all rows, with their sketches, to a shuffle."""
    rows = spark.range(10).selectExpr("id % 5 AS node", "id AS sid", "id AS n", "array(id) AS sketch", "id AS label")
    mains = spark.range(5).selectExpr("id AS node", "id AS main", "2L AS m", "1L AS others")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = chosen_path.small_nodes(rows, mains)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 10 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
