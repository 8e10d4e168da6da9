"""What the text operators share: reading, folds, shared scratch tables, byte-bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_crc(column: Column) -> Column:
    """crc32 of a value written as text; 0 for null, so that a row without an id still has a fold."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0))


def fold(column: Column, modulus: int, remainder: int) -> Column:
    """True where the row is held out."""
    return text_crc(column) % modulus == remainder


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share. Only a session
    without that setting (tests) gets one of its own, which then holds for the whole session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it (names differ by more than case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, its lineage is
    cut, and an executor that is lost later costs nothing."""
    path = shared_folder(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_KEPT: dict[Hashable, Any] = {}


def worker_keeps(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks under ``key``, made if it isn't there. It keeps one thing at a
    time: workers outlive a query, and what the operator before kept would stay beside the next one's."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        pieces = max(1, -(-batch.nbytes // limit))
        step = max(1, batch.num_rows // pieces)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def positions(frame: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """``frame`` with ``pos``, each row's place (from 0) in its group by ``order``, and ``total``, the group's rows.

    A distributed sort: rows are dealt by range of (group, order), numbered inside their range, and a
    range starts where the ranges before it end. So a group with most rows fills most ranges, and the only
    windows run over a row per (group, range). Groups must not be null.
    """
    ranged = frame.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ordered = staged(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    place = F.shiftright("at", 33).alias("range")  # the upper bits of the id are the partition's number
    runs = ordered.groupBy(*group, place).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    inside = W.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(inside.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(inside).alias("total"))
    numbered = ordered.withColumn("range", place).join(runs, [*group, "range"])
    return numbered.withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def byte_table(blanks: bytes) -> bytes:
    """A table for bytes.translate: A-Z to a-z, ``blanks`` to a space."""
    table = bytearray(bytes(range(256)).lower())
    for b in blanks:
        table[b] = 32
    return bytes(table)


def split_words(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, translated by ``table`` (space between words), in one buffer with one space
    after each; the words' starts and ends in it, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts).translate(table), np.uint8)
    keep = joined != 32
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    begins = np.flatnonzero(first)
    keep[1:] |= keep[:-1].copy()
    data = joined[keep]
    ends = np.flatnonzero(data == 32)
    if len(ends) < len(begins):
        ends = np.append(ends, len(data))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data.tobytes(), starts, ends, np.diff(np.searchsorted(begins, edges))


def lanes_of(data: bytes) -> np.ndarray:
    """The eight bytes from every offset on as one little-endian number, zeros behind the end."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


#: The five primes of XXH64 (fixed values of its specification).
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xxh64_of_length(lanes: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of many strings of one length below 32."""
    h, at = np.full(len(starts), (seed + int(_P[4]) + length) % (1 << 64), np.uint64), 0
    while length - at >= 8:
        h ^= _turned(lanes[starts + at] * _P[1], 31) * _P[0]
        h = _turned(h, 27) * _P[0] + _P[3]
        at += 8
    rest = lanes[starts + at]
    if length - at >= 4:
        h ^= (rest & np.uint64(0xFFFFFFFF)) * _P[0]
        h = _turned(h, 23) * _P[1] + _P[2]
        rest = rest >> np.uint64(32)
        at += 4
    for _ in range(length - at):
        h ^= (rest & np.uint64(0xFF)) * _P[4]
        h = _turned(h, 11) * _P[0]
        rest = rest >> np.uint64(8)
    for shift, prime in ((33, _P[1]), (29, _P[2])):
        h = (h ^ (h >> np.uint64(shift))) * prime
    return h ^ (h >> np.uint64(32))


def by_length(lengths: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows of that length); all longer ones come as ``most + 1``."""
    short = np.minimum(lengths, most + 1).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(short, minlength=most + 2))])
    for length in range(most + 2):
        if edges[length] < edges[length + 1]:
            yield length, order[edges[length] : edges[length + 1]]


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of every ``data[start : start + length]``: short strings a length at a time, others one by one."""
    lanes, out = lanes_of(data), np.zeros(len(starts), np.uint64)
    for length, rows in by_length(lengths, 31):
        if length < 32:
            out[rows] = _xxh64_of_length(lanes, starts[rows], length, seed)
        else:
            ends = (starts[rows] + lengths[rows]).tolist()
            out[rows] = np.fromiter((xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts[rows].tolist(), ends)), np.uint64, len(rows))
    return out
