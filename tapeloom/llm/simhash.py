"""Near duplicates by SimHash, with pivot distance tables.

1. *Fingerprints.* A bit of a document's fingerprint is set if it is set in over half the hashes of
   its shingles. Documents with equal fingerprints are one row from there on.
2. *Dealing.* Fingerprints that differ in at most ``most`` bits agree on all bits of ``segments - most``
   segments, so each is dealt into one bucket per choice of so many segments. The number of segments follows
   the number of fingerprints: it weighs copies against pairs and never changes the result. A bucket above
   ``part`` rows is cut into parts, with a seat for each pair of parts.
3. *Pivot tables.* In a task every fingerprint's Hamming distances to the reference fingerprints are computed
   once. Two fingerprints differ in at least as many bits as their distances to any one reference, so a
   pair is discarded as soon as one coordinate differs by more than ``most``; what is left is verified.
   A large seat takes references from its own rows too: all within ``most`` bits of one are linked with it, so groups
   of near copies become stars at one scan per reference, and only pairs of different groups are looked at.
4. *Components.* A seat tells each row's group, not its pairs; large-star / small-star steps join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import byte_table, byte_texts, split_words, staged, text_slices, xxh64
from tapeloom.llm.jaccard_join import components

#: The reference fingerprints of every table: hashes of their numbers.
REFERENCES = np.array([xxhash.xxh64_intdigest(str(k), seed=11) for k in range(24)], np.uint64)
#: A seat with more rows takes references from its own rows too, this many at most.
LARGE, OWN_REFERENCES = 128, 256
_TABLE = byte_table(b"\t\n\x0b\x0c\r")


def bit_majority(hashes: np.ndarray, portion: int = 1 << 16) -> np.ndarray:
    """The number whose bits are set that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), portion):
        part = hashes[at : at + portion].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """SimHash (XXH64, seed 42) of each text's ``width``-word shingles (fewer words: all of them as one;
    none: zero)."""
    data, starts, ends, counts = split_words(texts, _TABLE)
    last = np.cumsum(counts)
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    # a shingle ends width - 1 words after its start, but not beyond its text
    whole = np.minimum(np.arange(len(starts)) + width, np.repeat(last, counts)) - 1
    first = np.arange(len(starts)) - np.repeat(last - counts, counts) < np.repeat(shingles, counts)
    hashes = xxh64(data, starts[first], ends[whole[first]] - starts[first], 42)
    out, at = np.zeros(len(texts), np.uint64), 0
    for row, n in enumerate(shingles.tolist()):
        if n:
            out[row] = bit_majority(hashes[at : at + n])
        at += n
    return out


def fingerprint_documents(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            fp = fingerprints(byte_texts(batch), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {kind}, fp long")


def segment_masks(n: int, most: int) -> list[int]:
    """Masks (signed) such that two fingerprints within ``most`` bits agree under one of them: all choices of
    ``s - most`` out of s segments, s being the cheapest for n fingerprints."""

    def cost(s: int) -> float:  # a dealt copy weighs some 20 compared pairs
        return comb(s, most) * n * (20 + n / 2 / 2.0 ** (64 * (s - most) // s))

    s = min(range(most + 1, most + 5), key=cost)
    edges = [64 * k // s for k in range(s + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(parts, s - most)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def dealt(prints: DataFrame, masks: list[int], part: int) -> DataFrame:
    """(seat, fp): every fingerprint in the seats where it meets all others of each of its buckets."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    entries = prints.select("fp", F.explode(keys).alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1")
    parts = F.ceil(F.col("rows") / part).cast("int")
    placed = entries.join(sizes.select("bucket", parts.alias("parts")), "bucket")
    own = F.pmod(F.xxhash64("fp", "bucket"), F.col("parts")).cast("int")
    met = placed.select("fp", "bucket", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    seat = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    # of the seat where a part meets itself there is no need if it meets another
    return met.filter("parts = 1 or own <> other").select(seat.alias("seat"), "fp")


def _survivors(table: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) whose coordinates differ by at most ``most`` in every column of the table."""
    for column in table:
        if not len(i):
            break
        fits = np.abs(column[i] - column[j]) <= most
        i, j = i[fits], j[fits]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest row that each row is joined with, by the pairs (i, j) and groups known before."""
    root = np.arange(n) if root is None else root.copy()
    while len(i):
        a, b = root[i], root[j]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def pivot_table(fp: np.ndarray, references: np.ndarray) -> list[np.ndarray]:
    """Hamming distances of every fingerprint to each reference, a column per reference."""
    return [np.bitwise_count(fp ^ r).astype(np.int8) for r in references]


def large_seat(fp: np.ndarray, table: list[np.ndarray], most: int, portion: int = 1 << 20) -> np.ndarray:
    """Roots of one seat's rows. References from the rows themselves link all within ``most`` bits; pairs
    of different groups are then checked by the table."""
    bare, own, i, j = np.ones(len(fp), bool), [], [], []
    while len(own) < OWN_REFERENCES and bare.any():
        r = int(bare.argmax())
        own.append(np.bitwise_count(fp ^ fp[r]).astype(np.int8))
        near = np.flatnonzero(own[-1] <= most)
        bare[near] = False
        i.append(near)
        j.append(np.full(len(near), r))
    root = _roots(len(fp), np.concatenate(i), np.concatenate(j))
    if (root == root[0]).all():
        return root
    order = np.argsort(table[0], kind="stable")  # near in the first coordinate: a window of the sorted rows
    sorted_first = table[0][order]
    upto = np.searchsorted(sorted_first, sorted_first + most, side="right")
    step = max(1, portion // len(fp))
    for at in range(0, len(fp), step):
        rows = np.arange(at, min(at + step, len(fp)))
        width = upto[rows] - rows - 1
        a = np.repeat(rows, width)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
        a, b = order[a], order[b]
        apart = root[a] != root[b]
        a, b = _survivors(own[:8] + table[1:], a[apart], b[apart], most)
        good = np.bitwise_count(fp[a] ^ fp[b]) <= most
        root = _roots(len(fp), a[good], b[good], root)
    return root


def small_seats(fp: np.ndarray, table: list[np.ndarray], sizes: np.ndarray, most: int, portion: int = 1 << 20) -> np.ndarray:
    """Roots of the rows of many seats, which follow each other with these sizes."""
    starts, root = np.cumsum(sizes) - sizes, np.arange(len(fp))
    for d in np.unique(sizes[(sizes > 1) & (sizes <= LARGE)]):
        runs = starts[sizes == d]
        first, second = np.triu_indices(int(d), 1)
        step = max(1, portion // len(first))
        for at in range(0, len(runs), step):
            part = runs[at : at + step, None]
            i, j = _survivors(table, (part + first).ravel(), (part + second).ravel(), most)
            good = np.bitwise_count(fp[i] ^ fp[j]) <= most
            root = _roots(len(fp), i[good], j[good], root)
    for start, d in zip(starts[sizes > LARGE].tolist(), sizes[sizes > LARGE].tolist()):
        part = slice(start, start + d)
        root[part] = start + large_seat(fp[part], [c[part] for c in table], most)
    return root


def linked(seats: DataFrame, most: int) -> DataFrame:
    """(a, b): in every seat an edge from each linked fingerprint to the first of its group."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # rows of the last seat, which may go on

        def told(seat: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate([[True], seat[1:] != seat[:-1], [True]]))
            bits = fp.view(np.uint64)
            root = small_seats(bits, pivot_table(bits, REFERENCES), np.diff(cuts), most)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                seat, fp = (np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("seat", "fp")))
                end = int(np.flatnonzero(seat != seat[-1])[-1]) + 1 if seat[0] != seat[-1] else 0
                rest = (seat[end:], fp[end:])
                if end:
                    yield told(seat[:end], fp[:end])
        if len(rest[0]):
            yield told(*rest)

    ordered = seats.repartition("seat").sortWithinPartitions("seat")
    return ordered.mapInArrow(joined, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, most: int = 4, part: int = 1024) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    ``fingerprint`` is 16 lowercase hex digits; documents link when theirs differ in at most ``most`` bits;
    component_id is the smallest doc_id that links reach. A null, empty or blank text has
    fingerprint zero and links like any other. A null doc_id joins in but names no component unless
    nothing else can (then null). Repeated rows are linked with each other. An empty table gives an empty result;
    other columns are ignored.
    """
    marked = staged(fingerprint_documents(docs, width), "marked")
    prints = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    masks = segment_masks(prints.count(), most)
    roots = components(linked(dealt(prints.select("fp"), masks, part), most))
    grouped = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    per_print = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(per_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
