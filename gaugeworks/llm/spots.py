"""Document fingerprints from spot signatures.

A spot is a common word (the anchor) with the chain of the next ``CHAIN`` content words, common words between them
skipped.  Where no common word is near (lists, tables, junk), a content word directly followed by ``CHAIN`` content words
is an anchor too.  A text's fingerprint is the sorted set of its hashed spots; a text without any has its whole word
sequence instead, and a text without a word its characters.  Likeness is the Jaccard index of two sets.  ``near_pairs`` finds like fingerprints: distinct sets are
partitioned by length, so that only neighbouring classes can meet, each is filed under its shortest sufficient prefix, and
candidates whose lengths already rule the threshold out are dropped before their sets are compared.

The next document in order of id comes from range buckets: split points are ids of the table itself, so the
first row of a bucket is known and copied into the bucket before it; one shuffle and one window per bucket, no global
order.  Only built-in functions run.

Cases: null texts count as empty; the fingerprint of an empty text is empty and two empty sets are alike (1), an empty and
another one are not (0); equal texts have equal fingerprints; a repeated id is followed by its next row in order of text;
rows with a null id have no next document; the last row is followed by the first; an empty frame gives an empty
result.  Columns named like results are replaced; working columns start with ``_sp_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was with as be by this are at from or an have not "
    "der die das und den von zu ist mit des im dem nicht ein eine auf sich auch es "
    "le la les et de du un une que qui dans en pour pas sur au est par il "
    "el los las y del se por una con para su al lo como más o no"
).split()
CHAIN = 2
BUCKETS = 2048
BUCKET_ROWS = 500


def _any_of(found: list[str]) -> str:
    """Pattern of any of the words, common beginnings taken together so that a miss costs a few comparisons."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(found)):
        by_first.setdefault(w[:1], []).append(w[1:])
    parts = [c + (_any_of(rest) if len(rest) > 1 else rest[0]) for c, rest in by_first.items() if c]
    return "(?:" + "|".join(parts + [""] * ("" in by_first)) + ")"


def _pattern() -> tuple[str, str]:
    common = _any_of(ANCHORS)
    skipping = f" (?:{common} )*+[^ ]+"
    content = f"(?!{common} )[^ ]+"
    plain = " ".join([content] * (CHAIN + 1))
    return f"(?= ({common}{skipping * CHAIN}|{plain}) )", f" {common}(?= )"


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of the spots of a text (array of int)."""
    spot, common = _pattern()
    plain = F.coalesce(text, F.lit(""))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    spots = F.array_distinct(F.transform(F.regexp_extract_all(words, F.lit(spot), F.lit(1)), lambda s: F.hash(F.regexp_replace(s, common, ""))))
    whole = F.when(F.length(F.trim(words)) > 0, F.array(F.hash(F.trim(words)))).when(plain != "", F.array(F.hash(plain))).otherwise(F.array().cast("array<int>"))
    # The list with the whole text behind it has an element to look at in any case.
    return F.array_sort(F.transform(F.array(spots), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))[0])


def as_text(signature: Column) -> Column:
    """Fingerprint as text: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(df: DataFrame, id_col: str, cols: dict[str, str], text: str = "text") -> DataFrame:
    """Add to each row the values of the next row in order of id: ``cols`` maps columns to new names."""
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL")
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(BUCKETS)])
    n, first, points = ids.agg(F.count("*"), F.min("id"), F.percentile_approx("id", shares, 20 * BUCKETS)).first()
    step = max(1, BUCKETS * BUCKET_ROWS // max(n, 1))
    starts = sorted({first, *points[::step]}) if n else [0]

    key = F.col(id_col).cast("long")
    start = F.array(*[F.lit(p).cast("long") for p in starts])
    own = F.size(F.filter(start, lambda p: p <= key))
    # The first row of each bucket also ends the bucket before it; the very first ends the last one.
    before = F.when(own > 1, own - 1).otherwise(F.lit(len(starts)))
    places = F.when(F.array_contains(start, key), F.array(F.struct(own.alias("b"), F.lit(0).alias("o")), F.struct(before.alias("b"), F.lit(1).alias("o"))))
    alone = F.array(F.struct((-1 - F.pmod(F.xxhash64(text), F.lit(BUCKETS))).cast("int").alias("b"), F.lit(0).alias("o")))
    places = F.when(key.isNull(), alone).otherwise(F.coalesce(places, F.array(F.struct(own.alias("b"), F.lit(0).alias("o")))))
    dealt = df.withColumn("_sp_p", F.explode(places)).withColumn("_sp_b", F.col("_sp_p.b")).withColumn("_sp_o", F.col("_sp_p.o")).drop("_sp_p")
    order = Window.partitionBy("_sp_b").orderBy("_sp_o", id_col, text)
    kept = [c for c in df.columns if c not in cols.values()]
    ahead = dealt.select(*kept, "_sp_b", "_sp_o", *[F.lead(c).over(order).alias(new) for c, new in cols.items()])
    return ahead.where(F.col("_sp_o") == 0).select(*kept, *[F.when(F.col("_sp_b") > 0, F.col(new)).alias(new) for new in cols.values()])


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by the first as many characters of the following text."""
    plain, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(plain, F.lit(1), (n - k).cast("int")), F.substring(F.coalesce(following, F.lit("")), F.lit(1), k))


def near_pairs(df: DataFrame, id_col: str, signature: str, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct signature sets with a Jaccard index of at least the threshold, and the set of each row.

    Returns ``(pairs, members)``: pairs (a, b, likeness) of set ids, and (id, set_id) of every row with a non-empty set.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(signature).alias("s")).where(F.size("s") > 0)
    members = rows.select("id", F.sha2(as_text(F.col("s")), 256).alias("set_id"))
    sets = rows.groupBy(F.sha2(as_text(F.col("s")), 256).alias("set_id")).agg(F.first("s").alias("s"), F.size(F.first("s")).alias("n"))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))).cast("int")
    prefix = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)
    filed = sets.select("set_id", "n", band.alias("band"), F.explode(prefix).alias("sig"))
    left = filed.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    a, b = left.alias("a"), filed.alias("b")
    in_order = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.set_id") < F.col("b.set_id")))
    possible = (
        a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.sig") == F.col("b.sig")) & in_order & (F.col("a.n") >= F.col("b.n") * threshold))
        .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))
        .distinct()
    )
    sa, sb = sets.select(F.col("set_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("set_id").alias("b"), F.col("s").alias("sb"))
    pairs = possible.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
    return pairs, members
