"""Best-fit packing with certified partitions.

Documents become token ids, full sequences are cut off, and what is left of each document is an
item shorter than a sequence. Items are dealt at random over partitions of bounded size; each
partition is packed by best-fit decreasing, and dual feasible functions give a lower bound on the
sequences that any packing of its items needs. Where the two agree the partition is certified
and final. The others give up the items of their sequences with room left: these are exchanged
(dealt anew over fewer partitions) and packed again, until all are certified or an exchange
saves nothing. Only (row, length) pairs move; each partition's memory is bounded by ``items``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import staged, text_slices, worker_keeps
from tapeloom.llm.token_counts import vocabulary_bytes

#: Bytes of words, of their ids and of what finds both that a worker keeps between batches.
CACHE_BYTES = 32 << 20
#: A control character that stands alone between new words, so that one sequence holds many of them.
MARK = "\x01"


class WordIds:
    """Texts -> their token ids, word by word.

    For a tokenizer that drops white space, no token and no normalisation crosses an ASCII blank,
    so a text's ids are the ids of its words in order. A batch is split and its words are numbered by
    Arrow, known words first: only new ones are encoded, together. They are kept until the cache is full
    (frequent words come early) and else serve that batch.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known = pa.array([], pa.string())
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # word k has ids[ends[k] : ends[k + 1]]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after the other, and each text's number of ids."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        before = len(self.known)
        numbered = pa.chunked_array([self.known, split.flatten()]).dictionary_encode()
        coded = numbered.chunk(numbered.num_chunks - 1)  # a text has a word at least, if only an empty one
        words, code = coded.dictionary, coded.indices.to_numpy()
        new, n = self._encode_new(words.slice(before).cast(pa.binary()))
        ids, ends = np.concatenate([self.ids, new]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        self._keep(words, ids, ends)
        sizes = np.diff(ends)
        stops = np.concatenate([[0], np.cumsum(sizes[code])])
        out = np.empty(stops[-1], "<u4")
        for k in range(0, len(code), 1 << 17):  # portions, so that places of ids take little memory
            part, first, stop = code[k : k + (1 << 17)], stops[k], stops[min(k + (1 << 17), len(code))]
            at = np.repeat(ends[part] - (stops[k : k + len(part)] - first), sizes[part])
            at += np.arange(len(at))
            out[first:stop] = ids[at]
        return out, np.diff(stops[np.asarray(split.offsets) - split.offsets[0].as_py()])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, lengths = self.batch(pa.array(texts, pa.binary()).view(pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1])]

    def _keep(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """The first of the words that fit in the cache; the known ones always do."""
        starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        room = int(np.searchsorted(starts[1:] - starts[0] + 4 * ends[1:] + 24 * np.arange(1, len(words) + 1), CACHE_BYTES, side="right"))
        if room > len(self.known):
            self.known = pa.concat_arrays([words.slice(0, room)])
            self.ids, self.ends = ids[: ends[room]].copy(), ends[: room + 1].copy()

    def _encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, and how many each has. A hundred words are one sequence with the mark behind each. Where
        the mark is no token of its own, or not found once per word, the words are told apart by their number."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        firsts = np.append(np.arange(0, len(words), 100), len(words))
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), words), f" {MARK} ".encode()).to_pylist()
        alone, *found = self.tokenizer.encode_batch_fast([MARK, *(f"{c.decode('utf-8', 'replace')} {MARK}" for c in chunks)], add_special_tokens=False)
        ids, counts, apart = [], [], []
        for k, (size, e) in enumerate(zip(np.diff(firsts).tolist(), found)):
            got = np.array(e.ids, "<u4")
            marks = np.flatnonzero(got == alone.ids[0]) if len(alone.ids) == 1 else np.zeros(0, np.int64)
            if len(marks) != size:
                apart.append(k)
            ids.append(np.delete(got, marks))
            counts.append(np.diff(marks, prepend=-1) - 1)
        if apart:
            told = [[w.decode("utf-8", "replace") for w in words[firsts[k] : firsts[k + 1]].to_pylist()] for k in apart]
            for k, e in zip(apart, self.tokenizer.encode_batch(told, is_pretokenized=True, add_special_tokens=False)):
                ids[k] = np.array(e.ids, "<u4")
                counts[k] = np.bincount(np.array(e.word_ids, np.int64), minlength=firsts[k + 1] - firsts[k])
        return np.concatenate(ids), np.concatenate(counts)


def _word_ids(vocabulary: Broadcast) -> WordIds:
    """This worker's words, kept between tasks."""

    def made() -> tuple[WordIds, bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return WordIds(Tokenizer.from_buffer(vocabulary.value)), vocabulary.value

    return worker_keeps(("packing", id(vocabulary.value)), made)[0]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every row of ``docs`` (doc_id, text): its ids, then
    ``end``, cut into pieces of ``capacity`` if longer. A null text is empty: one piece of length 1."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(tokenizer_path))
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary)
        for batch in text_slices(batches, 4 << 20):
            ids, lengths = words.batch(batch.column("text"))
            stops = np.cumsum(lengths)
            ids, stops = memoryview(np.insert(ids, stops, end)).cast("B"), (4 * (stops + np.arange(1, len(stops) + 1))).tolist()
            rows, piece, start, length, crc = [], [], [], [], []
            for row, (first, stop) in enumerate(zip([0, *stops], stops)):
                for k, at in enumerate(range(first, stop, step)):
                    part = ids[at : min(stop, at + step)]
                    rows.append(row)
                    piece.append(k)
                    start.append((at - first) // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of items of these lengths needs, by dual feasible functions.

    For each threshold t up to half the capacity: items above capacity - t count as a whole
    sequence, items below t as nothing, the rest by their length; and for each k, lengths are
    rounded to multiples of 1/k by u(x) = x where x (k + 1) is whole, else floor(x (k + 1)) / k.
    """
    if not len(lengths):
        return 0
    sizes, n = np.unique(lengths, return_counts=True)
    total = n * sizes
    small = np.concatenate([[0], np.cumsum(total)])
    count = np.concatenate([[0], np.cumsum(n)])
    best = -(-int(small[-1]) // capacity)
    for t in np.unique(np.concatenate([sizes[sizes <= capacity // 2], capacity - sizes[sizes > capacity // 2] + 1])):
        lo, hi = np.searchsorted(sizes, t), np.searchsorted(sizes, capacity - t, side="right")
        if hi >= lo:
            best = max(best, int(count[-1] - count[hi]) + -(-int(small[hi] - small[lo]) // capacity))
    for k in range(1, 33):
        whole, part = np.divmod(sizes * (k + 1), capacity)
        scaled = np.where(part == 0, sizes * k, whole * capacity)  # u(x) * k * capacity
        best = max(best, -(-int((scaled * n).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per item its bin and offset, per bin the room left."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r is set if a bin has room r
    left: list[int] = []
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins[item], offsets[item] = b, capacity - room
        left[b] = room - size
        if left[b]:
            open_bins[left[b]].append(b)
            rooms |= 1 << left[b]
    return bins, offsets, np.array(left, np.int64)


_PACKED = "row long, length long, part int, bin long, offset long, room long, gap long"


def pack_parts(items: DataFrame, parts: int, capacity: int, salt: int) -> DataFrame:
    """Deal (row, length) over ``parts`` partitions and pack each: its bins, the room left in each and
    the partition's gap to its lower bound."""

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        gap = len(left) - lower_bound(lengths, capacity)
        return pd.DataFrame({"row": frame["row"], "length": lengths, "part": np.int32(key[0]), "bin": bins, "offset": offsets, "room": left[bins], "gap": gap})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(pack, _PACKED)


def pack_items(items: DataFrame, capacity: int, part_items: int = 60_000, rounds: int = 6) -> DataFrame:
    """(row, length), lengths below ``capacity`` -> (row, sequence, offset); sequences are longs of
    their own per (round, partition, bin)."""
    number = lambda r: F.lit(r) * F.lit(1 << 56) + F.col("part").cast("long") * F.lit(1 << 32) + F.col("bin")
    done, todo, before = [], items, None
    for r in range(1, rounds + 1):
        size = todo.count()
        if size == 0:
            break
        parts = max(1, -(-size // part_items))
        packed = staged(pack_parts(todo, parts, capacity, r), "packed").withColumn("sequence", number(r))
        firsts = packed.filter("offset = 0")  # a row per sequence
        told = firsts.agg(F.count("*").alias("bins"), F.sum((F.col("gap") > 0).cast("int")).alias("open"), F.count(F.when((F.col("gap") > 0) & (F.col("room") > 0), 1)).alias("loose")).first()
        if before is not None and told.bins >= before[1]:
            done.append(before[0])  # the exchange saved nothing: the packing before it stands
            return _union(done)
        loose = (F.col("gap") > 0) & (F.col("room") > 0)
        if not told.open or r == rounds or parts == 1:
            done.append(packed)
            return _union(done)
        done.append(packed.filter(~loose))
        before = (packed.filter(loose), told.loose)
        todo = staged(before[0].select("row", "length"), "exchange")
    return _union(done) if done else items.select("row", F.lit(0).cast("long").alias("sequence"), F.lit(0).cast("long").alias("offset"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("row", "sequence", "offset")
    for f in frames[1:]:
        out = out.unionByName(f.select("row", "sequence", "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, part_items: int = 60_000, rounds: int = 6) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every row of ``docs``
    (doc_id, text) and its place.

    A null text is empty and holds ``end`` alone; a null doc_id stays null; repeated rows are
    packed as often as they occur; an empty table gives an empty result; other columns are
    ignored.
    """
    cut = token_pieces(docs, tokenizer_path, capacity, end).withColumn("row", F.monotonically_increasing_id())
    pieces = staged(cut, "pieces")
    placed = pack_items(pieces.filter(F.col("length") < capacity).select("row", "length"), capacity, part_items, rounds)
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    part = pieces.filter(F.col("length") < capacity).join(placed.withColumnRenamed("sequence", "sequence_id"), "row")
    return part.unionByName(full).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
