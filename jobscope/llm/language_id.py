"""Language ID by rank-order profiles.

A profile is a text's most frequent character n-grams in order.  Each language
has one, counted over all its training texts; a document gets the language
whose profile is nearest by the sum of how far out of place its n-grams are.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import doc_crc, register, table, texts
from .counts import summed, tallied

#: n-grams of 1 to ORDERS characters; the PROFILE most frequent of them make a profile.
ORDERS, PROFILE = 3, 300
#: Most (language, n-gram) rows that go to the driver and the workers: 20,000 languages.
MOST_ROWS = 20_000 * PROFILE
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: the code point plus one if it is a letter, else 1 (a word's edge)."""
    return np.array([c + 2 if chr(c).isalpha() else 1 for c in range(0x110000)], np.int64)


def ngrams(text: str) -> np.ndarray:
    """Keys of all n-grams of the lower-cased text; white space and signs are one edge between words."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = _letters()[c]
    c = np.concatenate([[1], c, [1]])
    c = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]  # one edge for a run of them
    if len(c) < 3:
        return np.zeros(0, np.int64)
    out = [c[c != 1]]
    if ORDERS > 1:
        two = c[:-1] << 21 | c[1:]
        out.append(two)
    if ORDERS > 2:
        out.append((two[:-1] << 21 | c[2:])[c[1:-1] != 1])
    return np.concatenate(out)


def profile(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    if len(keys) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


def _count(batches):
    """(lang, gram, n) of a partition, summed before it leaves the task."""
    held: dict[str, list] = {}
    size = 0

    def rows():
        for lang, parts in held.items():
            keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, counts = tallied(ngrams(text))
            parts = held.setdefault(lang, [])
            parts.append((keys, counts))
            size += len(keys)
            if len(parts) >= 200:
                before = sum(len(p[0]) for p in parts)
                parts[:] = [summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                size -= before - len(parts[0][0])
            if size > 4_000_000:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """Language profiles of the rows of ``docs`` (text, lang) that have a language.

    The result has PROFILE n-grams for each distinct language, whatever the
    number of texts; more than MOST_ROWS rows are refused.
    """
    W.small_batches(docs.sparkSession)
    known = docs.where("lang is not null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "gram", "place")
    rows = top.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"lang has over {MOST_ROWS // PROFILE} values; is it a language column?")
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        found.setdefault(r.lang, []).append(r.gram)
    return found


def predictor(profiles: dict[str, list[int]]):
    """A mapInArrow function over (row, text, ...) that puts lang_pred and score behind the columns but ``text``."""
    langs = sorted(profiles)

    def predict(batches):
        grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        ranks = np.full((len(grams) + 1, len(langs)), -1, np.int64)
        for i, lang in enumerate(langs):
            ranks[np.searchsorted(grams, profiles[lang]), i] = np.arange(len(profiles[lang]))

        def one(text: str) -> tuple[str, float]:
            own = profile(*tallied(ngrams(text)))
            if not len(own) or not langs:
                return UNKNOWN, 0.0
            at = np.searchsorted(grams, own)
            at[grams[np.minimum(at, len(grams) - 1)] != own] = len(grams)
            there = ranks[at]
            apart = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
            best = int(np.argmin(apart))
            return langs[best], float(1 - apart[best] / (len(own) * PROFILE))

        for batch in batches:
            got = [one(t) for t in batch.column("text").to_pylist()]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2 and whose lang
    is not null.  ``und`` with score 0 where the text is null or has no letter,
    and for every row if nothing could be learned.  Equal distances go to the
    first language in text order.  The score is 1 less the distance's share of
    the largest possible one.
    """
    docs = docs.withColumn("_held", doc_crc() % 4 == 2)
    profiles = learn(docs.where("not _held"))
    W.small_batches(docs.sparkSession)
    rows = texts(docs, F.col("_held").alias("held_out")).select("doc_id", "held_out", "text")
    return rows.mapInArrow(predictor(profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known (lang_pred is not ``und``)."""
    profiles = learn(docs.where(doc_crc() % 4 != 2))
    W.small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(predictor(profiles), f"row {kind}, lang_pred string, score double")
    return out.where(F.col("lang_pred") != UNKNOWN).select("row.*")


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
