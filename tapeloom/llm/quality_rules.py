"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so the verdict doesn't depend on the rules' order, but
the work does. The operator times every rule alone on a bounded sample, counts what it rejects,
and runs the rules in descending order of rejections per second; a document leaves the cascade
at the first rule that rejects it, and statistics are computed when a rule first asks for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import text_slices
from tapeloom.llm.features import Text


class QualityRule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def few_words(t: Text) -> bool:
    return t.n_words < 20


def repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > 30 * t.n_words


def symbols(t: Text) -> bool:
    return 100 * t.n_symbols > 10 * t.n_words


def duplicate_lines(t: Text) -> bool:
    return 100 * t.n_dup_lines > 50 * len(t.lines)


def word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 14 * t.n_words


def stutter(t: Text) -> bool:
    return 100 * t.n_stutters > 30 * t.n_words


def shouting(t: Text) -> bool:
    return 100 * t.n_shouts > 30 * t.n_words


def capitals(t: Text) -> bool:
    return 100 * t.n_capitals > 50 * t.n_words


def letters(t: Text) -> bool:
    return 100 * t.n_lettered < 60 * t.n_words


BASE = [QualityRule(f.__name__, f) for f in (few_words, repeats)]
EXTRA = [QualityRule(f.__name__, f) for f in (symbols, duplicate_lines, word_length, stutter, shouting, capitals, letters)]


def cascade_order(docs: DataFrame, rules: list[QualityRule], sample_rows: int = 2_000, seed: int = 7) -> list[QualityRule]:
    """The rules by rejections per second on about ``sample_rows`` documents. The sample steers
    the order alone; without a sample the given order stays."""
    rows = docs.count()
    if rows == 0:
        return rules
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / rows), seed=seed)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                for k, rule in enumerate(rules):
                    t = Text(text)
                    began = time.perf_counter()
                    rejected[k] += rule.rejects(t)
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent, pa.float64()), pa.array(rejected, pa.int64())], ["rule", "seconds", "rejected"])

    found = sample.mapInArrow(timed, "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    rate = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), k))]


def judge_quality(docs: DataFrame, rules: list[QualityRule] = EXTRA, sample_rows: int = 2_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every
    row of ``docs`` (doc_id, text).

    The base statistics are results, so they are computed for all; ``rules`` run as a cascade on
    what passes the base. A null text is empty: no words, base_failed, not kept. A null doc_id stays
    null; repeated rows give repeated results; an empty table an empty result; other columns are
    ignored.
    """
    ordered = cascade_order(docs, rules, sample_rows)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                t = Text(text)
                failed = any(r.rejects(t) for r in BASE)
                kept = not failed and not any(r.rejects(t) for r in ordered)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judged, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: list[QualityRule] = BASE + EXTRA, sample_rows: int = 2_000) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects: the whole cascade, nothing else
    computed. A null text is empty and goes."""
    ordered = cascade_order(docs, rules, sample_rows)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            good = []
            for text in batch.column("text").to_pylist():
                t = Text(text)
                good.append(not any(r.rejects(t) for r in ordered))
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(passing, docs.schema)
