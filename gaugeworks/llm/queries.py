"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    both = documents(spark, sf_dir).select("doc_id", round_trip(F.col("text"), tokenizer_path("word_bpe_49k.json")).alias("r"))
    return both.select(
        "doc_id",
        (F.octet_length("r.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("r.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return (
        documents(spark, sf_dir)
        .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count_tokens(F.col("text"), tokenizer_path("byte_bpe_50k.json")).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > 512)
    )


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir).select("doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    """Packed pieces of documents."""
    from .packing import pack, pieces

    cut_up = docs.select("doc_id", F.explode(pieces(F.col("text"), tokenizer_path("word_bpe_49k.json"))).alias("p")).select("doc_id", "p.*")
    return pack(cut_up, order=("doc_id", "piece"))


LINES_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), keyed AS (
    SELECT doc_id, line, pos,
        translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.doc_id, k.line, k.pos, s.keep IS NOT NULL AND s.keep <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    docs = documents(spark, sf_dir).select("doc_id", "text")
    judged = lines.with_keep(docs, lines.keep_bitmaps(docs))
    return judged.select(
        "doc_id",
        F.size(lines.lines_of(F.col("text"))).cast("long").alias("n_lines"),
        lines.n_dropped(F.col("keep")).alias("n_dropped"),
        F.sha2(lines.kept_text(F.col("text"), F.col("keep")).cast("binary"), 256).alias("kept_sha256"),
    )


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op8_exact_topk", TOPK_SQL)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantise, search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantise(F.col("embedding")).alias("vector"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def learnt_from(doc_id: str = "doc_id"):
    """Documents that language identification may learn from; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def with_language(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    from .langid import fit, predict

    model = fit(labelled.where(learnt_from()), "doc_id", "text", "lang")
    return docs.withColumn("_li", predict(spark, F.col("text"), model))


@query("op4_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = with_language(spark, docs.select("doc_id", "text"), docs)
    return found.select("doc_id", F.coalesce(~learnt_from(), F.lit(False)).alias("held_out"), F.col("_li.lang").alias("lang_pred"), F.col("_li.score").alias("score"))


@query("op6_spot_signatures")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spots import as_text, edited, likeness, signatures, with_next

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = with_next(docs.withColumn("sig", signatures(F.col("text"))), "doc_id", {"text": "next_text", "sig": "next_sig"})
    changed = marked.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_sig", signatures(F.col("edited")))
    return changed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.coalesce("next_sig", F.array().cast("array<int>"))).alias("near_next"),
    )


@query("op10_ngram_scores")
def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model = train(docs.where(~held_out))
    found = docs.withColumn("s", score(F.col("text"), model))
    return found.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "s.n_tokens",
        "s.n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "s.base_score",
        "s.score",
    )


@query("op9_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_groups

    return near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op2_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import kept, repeated_spans, with_spans

    docs = documents(spark, sf_dir).select("doc_id", "text")
    judged = with_spans(docs, repeated_spans(docs)).withColumn("k", kept(F.col("text"), F.col("spans")))
    return judged.select("doc_id", "k.n_words", "k.n_removed", F.sha2(F.col("k.kept").cast("binary"), 256).alias("kept_sha256"))


def _merkle_sql(fan: int = 8, levels: int = 7) -> str:
    """The tree, the proofs and their check level by level: ``levels`` of them below the languages' roots, as many above."""

    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)) END"

    def leaf(text: str) -> str:
        return f"sha256(concat({', '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))}))"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""crcs AS (
    SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295], [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, (x % 2) * 3988292384)))) AS crc
    FROM (SELECT DISTINCT doc_id FROM documents)
)""",
        f"""leaves AS (
    SELECT d.doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
        row_number() OVER (PARTITION BY lang ORDER BY d.doc_id NULLS FIRST) - 1 AS pos,
        {leaf('text').replace('doc_id', 'd.doc_id')} AS leaf,
        {leaf(f"CASE WHEN crc % 3 = 0 THEN {low} ELSE text END").replace('doc_id', 'd.doc_id')} AS got
    FROM documents d LEFT JOIN crcs c ON d.doc_id = c.doc_id
)""",
        "l0 AS (SELECT g, pos, leaf AS h FROM leaves)",
    ]

    def level(name: str, below: str) -> str:
        # A group of one node is finished and stays as it is.
        return f"""{name} AS MATERIALIZED (
    SELECT g, pos, h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {below}) WHERE n = 1
    UNION ALL
    SELECT g, pos // {fan} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {below}) WHERE n > 1 GROUP BY g, pos // {fan}
)"""

    ctes += [level(f"l{k}", f"l{k - 1}") for k in range(1, levels + 1)]
    ctes.append(f"u0 AS (SELECT 0 AS g, g AS pos, h FROM l{levels})")
    ctes += [level(f"u{k}", f"u{k - 1}") for k in range(1, levels + 1)]
    at = "SELECT doc_id, g, pos, leaf, '' AS proof, got AS folded FROM leaves"
    for tree in "lu":
        for k in range(levels):
            runs = f"(SELECT g AS rg, pos // {fan} AS rp, list(h ORDER BY pos) AS hs, count(*) AS c, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {tree}{k}) GROUP BY ALL HAVING any_value(n) > 1)"
            left, right = f"array_to_string(hs[1:p.pos % {fan}], '')", f"array_to_string(hs[p.pos % {fan} + 2:], '')"
            ctes.append(f"""p{tree}{k} AS MATERIALIZED (
    SELECT doc_id, g, CASE WHEN hs IS NULL THEN p.pos ELSE p.pos // {fan} END AS pos, leaf,
        CASE WHEN hs IS NULL THEN proof ELSE concat(proof, {left}, {right}) END AS proof,
        CASE WHEN hs IS NULL THEN folded ELSE sha256(concat({left}, folded, {right})) END AS folded{', subroot' if tree == 'u' else ''}
    FROM ({at}) p LEFT JOIN {runs} r ON p.g = r.rg AND p.pos // {fan} = r.rp
)""")
            at = f"SELECT * FROM p{tree}{k}"
        if tree == "l":
            at = f"SELECT p.doc_id, 0 AS g, p.g AS pos, p.leaf, p.proof, p.folded, s.h AS subroot FROM pl{levels - 1} p JOIN l{levels} s ON s.g = p.g"
    return (
        "WITH "
        + ", ".join(ctes)
        + f" SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM ({at}) CROSS JOIN (SELECT h FROM u{levels})"
    )


@query("op11_merkle_manifest", _merkle_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import A_Z, leaf, manifest

    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    received = F.when(tampered, F.translate(text, A_Z, A_Z.lower())).otherwise(text)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return manifest(documents(spark, sf_dir), "doc_id", "lang", leaf(*fields, text), leaf(*fields, received))


NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM ranked WHERE rank <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine, quantised

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector"))
    return mine(rows, F.col("vec_id") % 50 == 0)


@query("op13_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_groups

    return near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
