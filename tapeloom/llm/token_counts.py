"""Token counts by a two-tier lookup on the map side.

A byte-level BPE tokenizer cuts a text into pre-tokens before it merges, and none of its
pre-tokens crosses from a non-blank to a blank. So a text's token count is the sum over its
blank-led runs, and each distinct run needs to be encoded once. Tier one is a compact broadcast
table of the runs that are frequent in the whole corpus (at most ``entries`` of them, each of
at most ``widest`` bytes: a proven bound of ``entries * (widest + 1)`` bytes). Tier two is a
bounded cache in each Python worker that encodes what tier one misses. No text, pre-token or
count is shuffled but the frequency candidates, and these choose speed, never results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import text_slices

#: Characters with Unicode's White_Space property (fixed values).
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Runs kept in a worker's cache before it starts anew, and the longest run that it keeps.
CACHE_RUNS, CACHE_CHARS = 300_000, 200
#: Texts above this many characters are walked run by run instead of as one list.
WALKED = 4_000_000


class Lengths(dict):
    """Run -> number of tokens; encodes what it doesn't know."""

    def __init__(self, tokenizer, known: dict[str, int]):
        super().__init__(known)
        self.tokenizer, self.known = tokenizer, known

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, run: str) -> int:
        n = self.whole(run)
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_RUNS + len(self.known):
                self.clear()
                self.update(self.known)
            self[run] = n
        return n

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            return self.whole(text)  # a special string cuts the text where a run does not
        if len(text) <= WALKED:
            return sum(map(self.__getitem__, RUN.findall(text)))
        return sum(self[m.group()] for m in RUN.finditer(text))

    specials: tuple[str, ...] = ()
    source: tuple = ()


#: This worker's lookup, made once and kept between tasks.
_WORKER: dict[tuple[int, int], Lengths] = {}


def _lengths(vocabulary: Broadcast, frequent: Broadcast | None) -> Lengths:
    key = (id(vocabulary.value), id(frequent.value) if frequent else 0)  # both live as long as the worker holds them
    if key not in _WORKER:
        from tokenizers import Tokenizer

        _WORKER.clear()
        tokenizer = Tokenizer.from_buffer(vocabulary.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        runs, counts = frequent.value if frequent else ("", [])
        lengths = Lengths(tokenizer, dict(zip(runs.split("\0"), map(int, counts))))
        lengths.specials = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        lengths.source = (vocabulary.value, frequent.value if frequent else None)
        _WORKER[key] = lengths
    return _WORKER[key]


def vocabulary_bytes(path: str) -> bytes:
    """The tokenizer file; it travels to the executors by broadcast (its size is the file's)."""
    with open(path, "rb") as f:
        return f.read()


def frequent_runs(docs: DataFrame, vocabulary: Broadcast, entries: int = 65_536, widest: int = 64) -> Broadcast:
    """The corpus's most frequent runs with their token counts, counted over all texts.

    Each task counts its own texts and names its ``entries`` best candidates; the sums of these
    are ranked. Runs that a task sees once are no candidates.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(RUN.findall(text) if len(text) <= WALKED else (m.group() for m in RUN.finditer(text)))
                    if len(seen) > 8 * entries:
                        seen = Counter(dict(seen.most_common(4 * entries)))
        best = [(r, n) for r, n in seen.most_common(entries) if n > 1 and "\0" not in r and len(r.encode()) <= widest]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["run", "n"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(vocabulary, None)
        for batch in batches:
            runs = batch.column("run").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array([lengths.count(r) for r in runs], pa.int32())], ["run", "n_tokens"])

    ranked = (
        docs.select("text").mapInArrow(candidates, "run string, n long")
        .groupBy("run").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "run").limit(entries)
    )
    rows = ranked.select("run").mapInArrow(measured, "run string, n_tokens int").collect()
    table = ("\0".join(r.run for r in rows), np.array([r.n_tokens for r in rows], np.int32))
    return docs.sparkSession.sparkContext.broadcast(table)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, entries: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows give
    repeated results; an empty table gives an empty result; other columns are never read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(tokenizer_path))
    frequent = frequent_runs(docs, vocabulary, entries)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(vocabulary, frequent)
        for batch in text_slices(batches):
            texts = batch.column("text")
            n = [lengths.count(t) if t else 0 for t in texts.to_pylist()]
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return sized.withColumn("over_limit", F.col("n_tokens") > limit)
