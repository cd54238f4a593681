import random

import pytest

ROOT = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice("the of and a thing ouwh eran hest Tion ing. on, re ndly anes und der ñ été".split()) + rng.choice(["", "", "s", "er", "x"]) for _ in range(n))


def sample_texts():
    """Prose with copies, near copies, shared passages and lines, junk, empty and long texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 20, 80, 300])) for _ in range(30)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    passage, line = prose(rng, 40), "All rights reserved by the thing company"
    shared = [prose(rng, 30) + " " + passage + " " + prose(rng, 10) for _ in range(6)]
    lined = [prose(rng, 5) + f"\n  {line.upper() if i % 2 else line}\t\n" + prose(rng, 5) for i in range(5)]
    odd = ["", None, " \n\t", "\n\n", "!!! ???", "a", "Is " * 300, "É" * 40, "x" * 70_000, prose(rng, 20_000), "a\x1cb\x1dc \x85 d e", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ İ 𝒳 🙂"]
    return base + base[:5] + near + shared + lined + odd


@pytest.fixture(scope="session")
def texts():
    return list(enumerate(sample_texts()))


@pytest.fixture(scope="session")
def frame(spark):
    """Frame of (doc_id, text) with extra columns named like results of the operators."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(list(rows), schema).repartition(3)
        for name in ("keep", "spans", "sequence_id", "offset", "n_tokens", "score", "lang", "n", "rank", "label", "set", "entry", "shard"):
            df = df.selectExpr("*", f"'mine' AS {name}")
        return df

    return make
