"""Document fingerprints from statistically improbable byte windows.

Every window of ``WINDOW`` bytes has an entropy, and an entropy is the rarer the fewer windows of
the corpus have it. A window becomes a feature if it is the rarest (leftmost on ties) of at least
``POPULAR`` of the ``REACH`` neighbourhoods around it, so features depend on content alone and
survive edits elsewhere. Features go, in text order, into a chain of Bloom filters of ``BITS``
bits, ``FULL`` features each; the chain is the fingerprint. Likeness compares each filter of the
shorter chain with its best match of the other: common bits beyond chance, as a share of the
most that could be common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import byte_texts, staged, text_slices

WINDOW, REACH, POPULAR = 32, 32, 8
#: Bytes to which a shorter text is repeated, so that it has features.
LEAST = 256
BITS, FULL, HASHES = 2048, 160, 5
#: Entropy classes: sum of c*log2(c) over a window's byte counts, in 1/2 steps; and the entropy (in
#: bits a byte) below which a window is so plain that all others are rarer.
SHIFT, CLASSES, PLAIN = 9, 512, 1.5
#: By how much of the way from chance to the most possible a common bit count must exceed chance.
MARGIN = 0.3
_G = np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)])
_GAIN = np.diff(np.round(_G * 1024)).astype(np.int32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def padded(text: bytes) -> bytes:
    """A short text is repeated, by a window more than itself at least; empty stays empty."""
    need = max(LEAST, len(text) + WINDOW)
    return text if not text or len(text) >= LEAST else (text * (need // len(text) + 1))[:need]


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of the window that begins at each byte (the last WINDOW - 1 bytes begin none).

    A byte that enters a window or leaves it changes the sum by a function of its count among
    the WINDOW - 1 bytes before (after) it; those counts come from comparing the data with itself
    at every distance below WINDOW.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    change = _GAIN[before]
    change[WINDOW:] -= _GAIN[after[:-WINDOW]]
    return (np.cumsum(change, dtype=np.int64)[WINDOW - 1 :] >> SHIFT).astype(np.int16)


def class_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of the whole corpus have each entropy class (``CLASSES`` numbers)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in text_slices(batches, 1 << 19):
            texts = [padded(t) for t in byte_texts(batch) if t]
            if texts:
                classes = entropy_classes(np.frombuffer(b"".join(texts), np.uint8))
                total += np.bincount(classes[_begins(texts, WINDOW)], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total)], ["class", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in docs.select("text").mapInArrow(counted, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r.n
    return out


def class_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy class, rarest first; plain windows (high sums) come last of all."""
    plain = (np.arange(CLASSES) << SHIFT) / 1024 > WINDOW * (np.log2(WINDOW) - PLAIN)
    order = np.lexsort((np.arange(CLASSES), counts, plain))
    ranks = np.empty(CLASSES, np.int64)
    ranks[order] = np.arange(CLASSES)
    ranks[plain] = CLASSES
    return ranks


def _begins(texts: list[bytes], width: int) -> np.ndarray:
    """Positions in the joined texts at which a window of ``width`` begins within its text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    edge = np.zeros(int(ends[-1]) + 1, np.int8)
    edge[ends - sizes] += 1
    edge[ends - width + 1] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters: an array (filters, BITS / 64) of 64-bit words."""
    empty = np.zeros((0, BITS // 64), np.uint64)
    full = [padded(t) for t in texts]
    real = [t for t in full if t]
    if not real:
        return [empty] * len(texts)
    data = np.frombuffer(b"".join(real), np.uint8)
    rank = ranks[entropy_classes(data)]
    lowest = (rank << 40) | np.arange(len(rank))
    step = 1
    while step < REACH:
        lowest = np.minimum(lowest[:-step], lowest[step:])
        step *= 2
    winners = lowest[_begins(real, WINDOW + REACH - 1)]
    popular = np.bincount(winners & ((1 << 40) - 1))
    at = np.flatnonzero(popular)
    sizes = np.fromiter(map(len, real), np.int64, len(real))
    owner = np.searchsorted(np.cumsum(sizes), at, side="right")
    plain = np.ones(len(real), bool)  # where nothing stands out (periodic texts) all winners count
    plain[owner[popular[at] >= POPULAR]] = False
    kept = (popular[at] >= POPULAR) | plain[owner]
    at, owner = at[kept], owner[kept]
    words = np.ascontiguousarray(data[at[:, None] + np.arange(WINDOW)]).view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(WINDOW // 8):
        h = (h ^ words[:, k]) * _MIX[k % 4]
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    features = np.bincount(owner, minlength=len(real))
    ordinal = np.arange(len(at)) - np.repeat(np.cumsum(features) - features, features)
    chain = -(-features // FULL)
    first = np.cumsum(chain) - chain
    bits = np.zeros((int(chain.sum()), BITS), np.uint8)
    for k in range(HASHES):
        bits[first[owner] + ordinal // FULL, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    filters = np.packbits(bits, axis=1).view("<u8")
    each = iter([filters[a : a + n] for a, n in zip(first, chain)])
    return [next(each) if t else empty for t in full]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Equal chains: 1; a chain without filters is like no other."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for f, n in zip(a, na):
        common = np.bitwise_count(f & b).sum(1, dtype=np.int64)
        most, chance = np.minimum(n, nb), n * nb / BITS
        floor = chance + MARGIN * (most - chance)
        total += max(0.0, float(((common - floor) / np.maximum(most - floor, 1e-9)).max()))
    return min(1.0, total / len(a))


def in_chunks(docs: DataFrame, chunk_rows: int = 1_000, intervals: int = 256) -> DataFrame:
    """(doc_id, text, chunk, head): every row in its chunk, a range of about ``chunk_rows`` ids, and
    once more, with ``head`` set, the row that follows each chunk's last one (after the last
    chunk: the first row of all).

    The chunk is found by arithmetic: ``intervals`` quantiles of the ids, each cut evenly. Chunks
    without rows don't matter: a head goes to the chunk before it that has rows.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    told = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / intervals for i in range(intervals + 1)], 10_000).alias("cuts")).first()
    cuts = sorted(set(told.cuts or [0]))
    each = max(1, -(-told.n // (chunk_rows * max(1, len(cuts) - 1))))
    lows = F.array(*[F.lit(c) for c in cuts[:-1] or cuts])
    highs = F.array(*[F.lit(c) for c in cuts[1:] or cuts])
    at = F.greatest(F.size(F.filter(lows, lambda c: c <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(lows, at), F.element_at(highs, at)
    inside = F.least(F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * each), F.lit(each - 1))
    last = len(cuts) * each
    rows = rows.withColumn("chunk", F.when(F.col("doc_id").isNull(), last + each).otherwise(at * each + F.greatest(inside, F.lit(0))).cast("long"))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "mark")).alias("first")
    order = W.orderBy("chunk")
    heads = rows.groupBy("chunk").agg(first)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = staged(heads.select("first.doc_id", "first.mark", F.coalesce(F.lag("chunk").over(order), F.max("chunk").over(whole)).alias("before")), "heads")
    found = rows.alias("r").join(heads.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.mark") == F.col("h.mark")))
    found = found.select("r.doc_id", "r.text", "r.mark", F.col("h.before").alias("chunk")).dropDuplicates(["chunk"])
    return rows.withColumn("head", F.lit(False)).unionByName(found.withColumn("head", F.lit(True)))


def fingerprint_documents(docs: DataFrame, chunk_rows: int = 1_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row
    of ``docs`` (doc_id integer, text).

    Rows follow each other by ascending doc_id, null ids last, rows that repeat an id by a hash of
    their text; the last is followed by the first, a single row by itself. A null text is empty:
    its fingerprint is the empty string, like 1 to itself and 0 to others. An empty table gives
    an empty result; other columns are ignored.
    """
    ranks = class_ranks(class_counts(docs))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its successor
        for batch in text_slices(batches, 1 << 18):
            new = list(zip(batch.column("chunk").to_pylist(), batch.column("head").to_pylist(), batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]))
            rows = ([held] if held else []) + new
            pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
            held = rows[-1]
            edited = [rows[k][3][: len(rows[k][3]) - len(rows[k][3]) // 4] + rows[k + 1][3][: len(rows[k][3]) // 4] for k in pairs]
            raw = [e.encode("utf-8", "surrogatepass") for e in edited]
            own = digests([r[3].encode("utf-8", "surrogatepass") for r in rows], ranks)
            new_ones = digests(raw, ranks)
            text = lambda d: base64.b64encode(d.tobytes()).decode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in pairs], kind), pa.array([len(rows[k][3]) for k in pairs], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                    pa.array([text(own[k]) for k in pairs], pa.string()), pa.array([text(d) for d in new_ones], pa.string()),
                    pa.array([likeness(own[k], d) for k, d in zip(pairs, new_ones)], pa.float64()),
                    pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    dealt = in_chunks(docs, chunk_rows).repartition("chunk").sortWithinPartitions("chunk", "head", F.col("doc_id").asc_nulls_last(), "mark")
    return dealt.select("doc_id", "text", "chunk", "head").mapInArrow(
        digested, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
