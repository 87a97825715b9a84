"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent letter n-grams (1 to 3, words padded by a space) in order of
frequency, ties by code points.  A text goes to the language with the least out-of-place distance: the sum over
the text's own profile of the difference in rank, an absent n-gram counting as the whole profile length.
Profiles are counted over all labelled rows given; no sample is taken.

However many labels there are, profiles are sent to the executors ``LANGUAGES`` at a time, and a text keeps the best
of them all.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if no language
was learned; equal distances go to the language that sorts first; rows with a null label teach nothing;
whole texts are counted, long ones piece by piece; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.llm.names import fresh, own
from pagemill.llm.scratch import Scratch

UNKNOWN = "und"
#: Texts are counted in pieces of so many characters.
PIECE = 1 << 20
#: A partition's counts are sent on when it holds so many distinct n-grams.
HELD = 1 << 21
#: Profiles sent to all executors at once (about 3 kB each).
LANGUAGES = 1000
#: Texts further from every profile than this are in none of the languages; random letters come to 0.25 at most.
LEAST_SCORE = 0.3
_BIGRAM = np.uint64(1 << 63)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point by code point, 0 for all that aren't letters."""
    table = np.zeros(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _grams(a: np.ndarray, known: int = 0) -> np.ndarray:
    """Keys of the n-grams of a padded stream of letters and single zeros that don't lie in its first ``known``."""
    one, two = np.uint64(42), np.uint64(21)
    high = a << one
    pairs = high[:-1] | (a[1:] << two)
    triples = (pairs[:-1] | a[2:])[a[1:-1] != 0]
    known = min(known, a.size)
    return np.concatenate([high[known:][a[known:] != 0], pairs[max(0, known - 1) :] | _BIGRAM, triples])


def count_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts over the whole text."""
    space, carry = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64)
    keys, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        a = _letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        a = np.concatenate([carry, a] if at + PIECE < len(text) else [carry, a, space])
        a = a[(a != 0) | np.r_[True, a[:-1] != 0]]
        found = [np.unique(_grams(a, carry.size if at else 0), return_counts=True)]
        keys, counts = merge([(keys, counts), *found]) if at else found[0]
        carry = a[-2:]
    return keys, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(keys.size, dtype=np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return keys, counts


def profile(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first, ties by key."""
    if keys.size > 4 * size:
        floor = np.partition(counts, counts.size - size)[counts.size - size]
        keys, counts = keys[counts >= floor], counts[counts >= floor]
    return keys[np.argsort(-counts, kind="stable")][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    waiting = 0

    def told():
        for lang, parts in held.items():
            keys, counts = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * keys.size, pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, counts = count_ngrams(text.as_py())
            held.setdefault(lang, []).append((keys, counts))
            waiting += keys.size
            if waiting > HELD:
                for at, parts in held.items():
                    held[at] = [merge(parts)]
                waiting = sum(parts[0][0].size for parts in held.values())
                if waiting > HELD // 2:
                    yield from told()
                    waiting = 0
    yield from told()


def profiles_of(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """``(lang, gram, rank)``: the ``size`` n-grams of each non-null label, counted over all rows, as a written table."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    total = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # unsigned order of the keys, as in a text's own profile
    key = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))).where(F.col("rank") <= size)
    return Scratch(labelled.sparkSession, "languages").write("profiles", best.select("lang", "gram", "rank"))


def _parts(best: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """Profiles of ``LANGUAGES`` languages at a time, in order of their names; the driver never holds more."""
    found: dict[str, list] = {}

    def told():
        return {lang: np.array(grams, dtype=np.int64).view(np.uint64) for lang, grams in found.items()}

    for lang, gram in best.orderBy("lang", "rank").select("lang", "gram").toLocalIterator():
        if lang not in found and len(found) == LANGUAGES:
            yield told()
            found.clear()
        found.setdefault(lang, []).append(gram)
    yield told()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> dict[str, np.ndarray]:
    """The profiles of all labels, for tables of few."""
    return {lang: p for part in _parts(profiles_of(labelled, text_col, lang_col, size)) for lang, p in part.items()}


def predicted(docs: DataFrame, best: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The documents with ``struct<lang_pred, score>`` in the column ``name``."""
    size = best.agg(F.max("rank")).first()[0] or 0
    scratch, done = Scratch(docs.sparkSession, "languages"), False
    for k, part in enumerate(_parts(best)):
        now = predict_column(F.col(text_col), part, size)
        if not done:
            docs, done = docs.withColumn(name, now), True
            continue
        # the plan holds the profiles of one part at a time
        docs = scratch.write(f"part-{k}", docs)
        (other,) = fresh(docs, "other")
        docs = docs.withColumn(other, now)
        docs = docs.withColumn(name, F.when(F.col(f"{other}.score") > F.col(f"{name}.score"), F.col(other)).otherwise(F.col(name))).drop(other)
    return docs


class Ranks:
    """Ranks of all profiles' n-grams by language, for one lookup a text."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int | None = None):
        self.langs, self.size = sorted(profiles), size or max([len(p) for p in profiles.values()], default=0)
        self.keys = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((self.keys.size + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        mine = profile(*count_ngrams(text), self.size)
        if not mine.size:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, mine)
        at[at >= self.keys.size] = 0
        ranks = self.ranks[np.where(self.keys[at] == mine, at, -1)]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(mine.size)[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (mine.size * self.size)


def predict_column(text, profiles: dict[str, np.ndarray], size: int | None = None):
    """A column ``struct<lang_pred string, score double>``."""
    ranks = Ranks(profiles, size)

    @arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        found = [ranks.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang_pred", "score"])

    return of(text)


def fold(id_col: str = "doc_id", folds: int = 3):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fold_of(doc_id: int, folds: int = 3) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``.

    Learns from the rows whose fold isn't 1; a null id neither teaches nor is held out.
    """
    best = profiles_of(docs.where(fold(id_col) != 1), text_col, lang_col, size)
    (name,) = fresh(docs, "p")
    said = predicted(docs.select(F.col(id_col), F.col(text_col)).withColumnRenamed(text_col, name + "_text"), best, name, name + "_text")
    return said.select(id_col, F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), f"{name}.lang_pred", f"{name}.score")


def keep_known(docs: DataFrame, languages: list[str] | None = None, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """The documents in one of the languages (all that can be learned, if none are stated), with that score at least.

    Texts that are null, hold no letter or lie far from every language go.  Without a single labelled text nothing is
    learned and every text with a letter stays.
    """
    best = profiles_of(docs.where(fold(id_col) != 1), text_col, lang_col, size)
    if best.isEmpty():
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    (name,) = fresh(docs, "p")
    found = predicted(docs, best, name, text_col)
    known = F.col(f"{name}.lang_pred") != UNKNOWN if languages is None else F.col(f"{name}.lang_pred").isin(*languages)
    return found.where(known & (F.col(f"{name}.score") >= least_score)).select(*own(docs))
