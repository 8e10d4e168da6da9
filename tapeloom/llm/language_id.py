"""Language identification by bit-sliced Bloom filters of n-grams.

One filter answers for all languages at once: a cell holds a bit per language, an n-gram sets its
language's bit in ``hashes`` cells, and the AND of those cells is the set of languages that hold
the n-gram. A text's count per language is a population count over its n-grams' masks; the
filter's false positives, known from each language's share of set bits, are taken out, and the
largest corrected count decides.

Learning counts every n-gram of every training text by language (summed per task, then over
tasks). An n-gram belongs to the languages in which its relative frequency reaches ``share`` of
its largest; of these each language keeps its ``capacity`` most frequent, so the filter's size, and
what passes the driver, has a bound: ``capacity`` rows a language, ``2**cells`` cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import text_slices

WIDTH = 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of the lower-cased texts, each with a blank before and blanks behind, and
    the position at which each text's begin (one more at the end)."""
    padded = [b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded)) - (WIDTH - 1)
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    keys = data[: len(data) - WIDTH + 1].copy()
    for i in range(1, WIDTH):
        keys <<= np.uint32(8)
        keys |= data[i : len(data) - WIDTH + 1 + i]
    sizes = np.maximum(sizes, 0)
    if len(padded) > 1:  # drop the windows that reach into the next text
        ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))[:-1]
        inside = np.ones(len(keys), bool)
        for i in range(1, WIDTH):
            inside[ends - i] = False
        keys = keys[inside]
    return keys, np.concatenate([[0], np.cumsum(sizes)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, lang, n) over all rows of (text, lang)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in text_slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = np.array(batch.column("text").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                keys, n = np.unique(grams(list(texts[langs == lang]))[0], return_counts=True)
                if lang in total:
                    keys = np.concatenate([total[lang][0], keys])
                    n = np.concatenate([total[lang][1], n])
                    keys, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, n, len(keys)).astype(np.int64)
                total[lang] = (keys, n)
        for lang, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array([lang] * len(keys), pa.string()), pa.array(n.astype(np.int64))], ["gram", "lang", "n"])

    return docs.select("text", "lang").mapInArrow(counted, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The bit-sliced filter: planes[p][cell] has bit b for language 64 * p + b (one plane of the
    smallest fitting width where there are few languages)."""

    def __init__(self, langs: list[str], cells: int, hashes: int):
        self.langs, self.bits, self.hashes = langs, cells, hashes
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(langs) <= 8 * k().nbytes), np.uint64)
        self.width = 8 * kind().nbytes
        self.planes = [np.zeros(1 << cells, kind) for _ in range(max(1, -(-len(langs) // self.width)))]
        self.false = np.zeros(len(langs))

    def cells(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (((keys.astype(np.uint64) + np.uint64(k + 1)) * _HASHES[k]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, lang: int, keys: np.ndarray) -> None:
        plane, bit = self.planes[lang // self.width], lang % self.width
        for k in range(self.hashes):
            plane[np.unique(self.cells(keys, k))] |= plane.dtype.type(1 << bit)

    def close(self) -> None:
        """Each language's rate of false positives: its share of set bits, once per hash."""
        for lang in range(len(self.langs)):
            plane, bit = self.planes[lang // self.width], lang % self.width
            self.false[lang] = float(((plane >> plane.dtype.type(bit)) & plane.dtype.type(1)).mean()) ** self.hashes

    def counts(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """n-grams per text and language, corrected for false positives (not below 0)."""
        n = np.diff(starts)
        out = np.zeros((len(n), len(self.langs)))
        full = n > 0
        cells = [self.cells(keys, k) for k in range(self.hashes)]
        for p, plane in enumerate(self.planes):
            masks = plane[cells[0]]
            for c in cells[1:]:
                masks &= plane[c]
            for bit in range(min(self.width, len(self.langs) - p * self.width)):
                lang = p * self.width + bit
                held = ((masks >> plane.dtype.type(bit)) & plane.dtype.type(1)).astype(np.int32)
                hits = np.add.reduceat(held, starts[:-1][full]) if full.any() else []
                out[full, lang] = (hits - n[full] * self.false[lang]) / max(1e-9, 1 - self.false[lang])
        return np.maximum(out, 0)


def learn_languages(docs: DataFrame, capacity: int = 131_072, share: float = 0.5, least: int = 2, cells: int = 21, hashes: int = 2) -> LanguageFilter:
    """The filter of all languages in ``docs`` (text, lang; rows with a null of either are left out)."""
    counts = gram_counts(docs.filter("text is not null and lang is not null"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("grams"))
    rated = counts.join(sizes, "lang").withColumn("rate", F.col("n") / F.col("grams"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.join(top, "gram").filter((F.col("rate") >= share * F.col("top")) & (F.col("n") >= least))
    ranked = kept.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= capacity)
    rows = ranked.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    found = {r.lang: np.array(r.grams, np.int64) for r in rows}
    known = LanguageFilter(sorted(found), cells, hashes)
    for i, lang in enumerate(known.langs):
        known.insert(i, found[lang])
    known.close()
    return known


def identify_languages(docs: DataFrame, known: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text).

    ``score`` is the winner's share of all corrected counts. A null text, one without a letter, or a
    filter without languages gives ``und`` and 0; a text none of whose n-grams is known gives the
    first language and 0; ties go to the first language in order. Repeated rows give repeated
    results, an empty table an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_slices(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            lettered = np.array([bool(t and _LETTER.search(t)) for t in texts])
            if not model.langs or not lettered.any():
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                counts = model.counts(*grams(texts))
                best = counts.argmax(axis=1)
                score = np.where(lettered, counts[np.arange(len(best)), best] / np.maximum(counts.sum(axis=1), 1e-9), 0.0)
                names = [model.langs[b] if l else UNKNOWN for b, l in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judged, f"doc_id {kind}, lang_pred string, score double")


def languages(docs: DataFrame, held_out: Column, **model) -> DataFrame:
    """Learn from the rows where ``held_out`` is false, predict all: doc_id, held_out, lang_pred, score."""
    known = learn_languages(docs.filter(~held_out), **model)
    predicted = identify_languages(docs, known)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
