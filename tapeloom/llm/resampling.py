"""Importance resampling towards a target distribution, over hashed n-gram features.

A document's weight is the sum of its features' gains: a feature's bucket gains by how much more often it
occurs in the target texts than in the documents. Gumbel noise, drawn from the id, added to the weight turns the
highest scores into a sample without replacement.

Features are never strings in a list. A batch's words lie in one buffer, an n-gram is a start and an end in it, and an
open-addressed table of NumPy arrays interns them: the slot of a key (XXH64 of the bytes) is found by linear
probing and an n-gram is taken for a slot's own only if its bytes are equal. A slot holds bucket and count,
so each distinct n-gram of a batch is put into its bucket once. The first scan adds the slots' counts by bucket,
the second gathers the gains of all occurrences by slot. Only histograms of ``buckets`` rows leave the
first scan, and only numbers leave the second: no text or feature is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_length, byte_table, byte_texts, lanes_of, positions, split_words, text_slices, xxh64

#: ASCII characters that no word has: all but digits and letters.
_TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: What crc32 makes of a single byte.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
#: n-grams that one table interns start at this many words at most, which bounds its arrays.
PORTION = 1 << 17


class Slots:
    """n-grams (start, end in a buffer) interned in an open-addressed table."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        n = len(starts)
        size = 1 << max(4, (2 * n).bit_length())
        self.data, self.starts, self.lengths = data, starts, ends - starts
        self.lanes = lanes_of(data)
        self.keys, self.owner = np.zeros(size, np.uint64), np.full(size, -1)
        self.ids = self._intern(xxh64(data, starts, self.lengths))
        self.counts = np.bincount(self.ids, minlength=size)
        self.filled = np.flatnonzero(self.owner >= 0)

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.lengths[a] == self.lengths[b]
        live, at = np.flatnonzero(same & (a != b)), 0
        while len(live):
            x, y = a[live], b[live]
            left = self.lengths[x] - at
            # of the last eight bytes only those of the n-gram count
            over = np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)
            differs = ((self.lanes[self.starts[x] + at] ^ self.lanes[self.starts[y] + at]) << over) != 0
            same[live[differs]] = False
            at += 8
            live = live[~differs & (left > 8)]
        return same

    def _intern(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        ids = (keys & mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            slot = ids[todo]
            free = self.owner[slot] < 0
            self.owner[slot[free]] = todo[free]  # of several the last one stays
            self.keys[slot[free]] = keys[self.owner[slot[free]]]
            owned = self.keys[slot] == keys[todo]
            owned[owned] = self._same_bytes(todo[owned], self.owner[slot[owned]])
            todo = todo[~owned]
            ids[todo] = (ids[todo] + 1) & int(mask)
        return ids

    def buckets(self, buckets: int) -> np.ndarray:
        """Bucket per slot: the crc32 of its n-gram, of n-grams of one length together, byte by byte."""
        out, owners = np.zeros(len(self.keys), np.int64), self.owner[self.filled]
        crc = np.zeros(len(owners), np.uint32)
        for length, rows in by_length(self.lengths[owners], 255):
            starts = self.starts[owners[rows]]
            if length < 256:
                c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
                for k in range(length):
                    if k % 8 == 0:
                        lane = self.lanes[starts + k]
                    c = _CRC[(c ^ lane.astype(np.uint32)) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
                    lane >>= np.uint64(8)
                crc[rows] = ~c
            else:
                ends = starts + self.lengths[owners[rows]]
                crc[rows] = [zlib.crc32(self.data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        out[self.filled] = crc % np.uint32(buckets)
        return out


def interned(texts: list[bytes], orders: int) -> tuple[np.ndarray, Iterator[tuple[Slots, np.ndarray]]]:
    """The number of words of each text, and tables of all their n-grams of 1 to ``orders`` words with the
    text that each occurrence is in."""
    data, starts, ends, counts = split_words(texts, _TABLE)
    text = np.repeat(np.arange(len(texts)), counts)
    last = np.repeat(np.cumsum(counts), counts)  # where the text's words end

    def tables() -> Iterator[tuple[Slots, np.ndarray]]:
        for at in range(0, len(starts), PORTION):
            word = np.arange(at, min(at + PORTION, len(starts)))
            of = [(w, w + k) for k in range(orders) for w in [word[word + k < last[word]]]]
            first, final = (np.concatenate(x) for x in zip(*of))
            yield Slots(data, starts[first], ends[final]), text[first]

    return counts, tables()


def bucket_counts(texts: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """Features of all rows of ``texts`` (text) by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, 2 << 20):
            for table, _ in interned(byte_texts(batch), orders)[1]:
                total += np.bincount(table.buckets(buckets), table.counts, buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    told = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in told.toArrow().to_pylist():  # a row per bucket at most
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) per bucket, each count raised by one."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, orders: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs`` (doc_id, text)."""
    told = docs.sparkSession.sparkContext.broadcast(gains)  # a number per bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            texts = byte_texts(batch)
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            words, tables = interned(texts, orders)
            for table, text in tables:
                gain = told.value[table.buckets(len(told.value))]
                n += np.bincount(text, minlength=len(texts))
                weight += np.bincount(text, gain[table.ids], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, orders: int = 3, buckets: int = 10_000, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) for every row of ``docs`` (doc_id, text); ``target`` has
    a text per row.

    rank numbers the drawn documents, the floor(``percent`` N / 100) highest scores of the N with
    ``least_words`` words or more, ties to the smaller doc_id; it is null for all others. A null text has no words:
    weight 0, never drawn. A null doc_id takes its noise from an empty id and comes last among ties. Repeated rows are
    drawn apart (equal rows are interchangeable). Without target texts all targets count 0; an empty
    table gives an empty result; other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    name = F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = weighed(docs, gains, orders).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("able", F.col("n_words") >= least_words)
    placed = positions(found.withColumn("all", F.lit(0)), ["all"], [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "weighed")
    drawn = placed.agg(F.coalesce(F.floor(F.count_if("able") * percent / 100), F.lit(0)).alias("n"))
    rank = F.when(F.col("able") & (F.col("pos") < drawn.scalar()), F.col("pos") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
