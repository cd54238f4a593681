"""Language identification by prediction by partial matching.

Each language has byte context trees of orders 0 to 4 with symbol counts learnt once and then frozen.  A byte costs
log2 of its probability in the longest context that knows it; each context that does not adds the cost of its
escape symbol (as many escapes as the context has different symbols).  A text goes to the language that codes it in the
fewest bits; the score is that language's share of the likelihoods.  All windows of a batch are scored once per
different window, for all languages together.

The trees are fitted on a bounded sample: at most ``sample_rows`` labelled rows a language, spread over all rows by
hash, of each the first ``sample_chars`` characters, so the model is bounded too; its size is checked before it is built and sent out.
Whole texts of all rows are scored.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn
from; equal code lengths go to the alphabetically first language; texts of any length are scored in slices; the results
are columns, so other columns stay as they are and an empty frame stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.series import is_small

ORDER = 4
SLICE = 1 << 19
MODEL_BYTES = 128 << 20
#: (language, window) counts that the driver takes at most; checked before it takes any.
MODEL_GRAMS = 1 << 22
UNKNOWN = "und"
SPACE = 1 << 62


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte windows of order + 1 bytes, packed, with the number of their text; in slices of bounded size."""
    pad = bytes(ORDER)
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        sizes = np.array([len(p) for p in parts])
        grams = np.zeros(len(flat) - ORDER, np.uint64)
        for k in range(ORDER + 1):
            grams |= flat[k : len(flat) - ORDER + k] << np.uint64(8 * (ORDER - k))
        inside = np.ones(len(flat), bool)
        starts = np.cumsum(sizes) - sizes
        for k in range(ORDER):  # the first bytes of a part are context only
            inside[starts + k] = False
        return grams[inside[ORDER:]], np.repeat(np.array(owners), sizes - ORDER)

    for i, text in enumerate(texts):
        raw = pad + text.lower().encode("utf-8", "surrogatepass")
        for lo in range(ORDER, len(raw), SLICE):
            parts.append(raw[lo - ORDER : lo + SLICE])
            owners.append(i)
            size += len(parts[-1])
            if size >= SLICE:
                yield flush()
                parts, owners, size = [], [], 0
    if parts:
        yield flush()


@dataclass
class Model:
    """Per order the known windows and contexts, sorted, with their costs in bits by language."""

    languages: list[str]
    symbols: list[np.ndarray]
    symbol_bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape_bits: list[np.ndarray]

    @property
    def size(self) -> int:
        return sum(a.nbytes for part in (self.symbols, self.symbol_bits, self.contexts, self.escape_bits) for a in part)

    @classmethod
    def of(cls, counts: pd.DataFrame) -> Model:
        """From columns lang, gram (order + 1 bytes), n."""
        languages = sorted(counts["lang"].unique())
        lang = np.searchsorted(languages, counts["lang"].to_numpy(str)) if len(languages) else np.empty(0, np.int64)
        gram, n = counts["gram"].to_numpy(np.int64).astype(np.uint64), counts["n"].to_numpy(np.float64)
        model = cls(languages, [], [], [], [])
        for k in range(ORDER + 1):
            keys, at = np.unique(gram & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
            table = np.zeros((len(keys), len(languages)))
            np.add.at(table, (at, lang), n)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, of, table)
            np.add.at(kinds, of, table > 0)
            both = total + kinds
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(table > 0, np.log2(both[of] / table), np.nan)
                escape = np.where(kinds > 0, np.log2(both / kinds), 0.0)
            model.symbols.append(keys)
            model.symbol_bits.append(bits.astype(np.float32))
            model.contexts.append(contexts)
            model.escape_bits.append(escape.astype(np.float32))
        return model

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window by language."""
        out = np.zeros((len(grams), len(self.languages)))
        pending = np.ones(out.shape, bool)
        for k in range(ORDER, -1, -1):
            key = grams & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(self.symbols[k], key), len(self.symbols[k]) - 1)
            bits = np.where((self.symbols[k][at] == key)[:, None], self.symbol_bits[k][at], np.nan)
            got = pending & ~np.isnan(bits)
            out[got] += bits[got]
            pending &= ~got
            if not pending.any():
                return out
            key >>= np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], key), len(self.contexts[k]) - 1)
            escape = np.where((self.contexts[k][at] == key)[:, None], self.escape_bits[k][at], 0.0)
            out[pending] += escape[pending]
        out[pending] += 8.0
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text by language."""
        out = np.zeros((len(texts), len(self.languages)))
        for grams, owner in windows(texts):
            kinds, at = np.unique(grams, return_inverse=True)
            cost = self.cost(kinds)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for j in range(len(self.languages)):
                out[owner[starts], j] += np.add.reduceat(cost[at, j], starts)
        return out


def fit(labelled: DataFrame, id_col: str, text: str, lang: str, sample_rows: int = 400, sample_chars: int = 1 << 16) -> Model:
    """Fit on a bounded sample: ``sample_rows`` rows a language by hash, of each the first ``sample_chars`` characters.

    Null ids, texts or labels are not learnt from.  The sample is sifted where the rows are read, so only about twice the
    wanted rows are shuffled.
    """
    rows = labelled.select(F.xxhash64(id_col, text).alias("h"), F.substring(text, 1, sample_chars).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(id_col).isNotNull())
    share = cut(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * sample_rows) / F.count("*")).alias("share")))
    # About twice the wanted rows pass by hash, so the ranking below sees few rows of any language.
    some = rows.join(F.broadcast(share) if is_small(share) else share, "lang").where((F.shiftrightunsigned("h", 2) / F.lit(float(SPACE))) < F.col("share"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= sample_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, part in b.groupby("lang"):
                for grams, _ in windows(list(part["text"])):
                    kinds, n = np.unique(grams, return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": kinds.astype(np.int64), "n": n})

    counts = ranked.select("lang", "text").mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    if counts.count() > MODEL_GRAMS:
        raise ValueError("the model would be larger than its bound; fit on fewer rows or languages")
    return Model.of(counts.toPandas())


def predict(spark: SparkSession, text: Column, model: Model) -> Column:
    """struct(lang, score, bits): best language, its share of the likelihoods, code length in bits."""
    if model.size > MODEL_BYTES:
        raise ValueError("the model is larger than its bound; fit on fewer rows")
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, bits double")
    def best(s: pd.Series, letters: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, score, bits = np.full(len(s), UNKNOWN, object), np.zeros(len(s)), np.zeros(len(s))
        at = np.flatnonzero(letters.to_numpy(bool)) if m.languages else np.empty(0, np.int64)
        if len(at):
            cost = m.bits([s.iloc[i] for i in at])
            least = cost.argmin(axis=1)
            low = cost.min(axis=1)
            lang[at] = np.array(m.languages, object)[least]
            score[at] = 1.0 / np.exp2(np.maximum(low[:, None] - cost, -1000)).sum(axis=1)
            bits[at] = low
        return pd.DataFrame({"lang": lang, "score": score, "bits": bits})

    return best(text, F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)))
