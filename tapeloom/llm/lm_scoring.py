"""Language-model scores: a unigram base line and prediction by partial matching (PPM) over bytes.

Both models are learned from all training texts by counting on Spark: words for the base line,
byte windows of ``ORDER + 1`` for the trie (each text has ORDER start bytes before it and an end
byte behind it, so counts of shorter contexts are sums of these). All counts are kept, whatever
their number. Up to ``nodes`` distinct windows they are broadcast as one trie; beyond, only the costs
of the most frequent windows are, and a text's other windows are joined with theirs, which
``window_costs`` takes from the tables of all orders. Both ways give the same scores.

PPM takes the longest known context. A symbol seen there costs its share of count + escapes
(method C: as many escapes as distinct symbols); any other symbol pays the escape and is looked
for in the next shorter context, with the symbols of the longer one excluded. As contexts of a
text are suffixes of each other, the excluded sums are known when the trie is built, and the
cost of each known window is one lookup in a hash table; only escapes walk the trie, all of a
batch at once.

Words are scored on the map side against a broadcast table of the ``frequent`` most frequent words;
occurrences of rarer words are joined with their counts, whatever their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import byte_texts, staged, text_slices

ORDER, START, END = 4, b"\xfe", b"\xff"
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One window (context and symbol, as a number) per byte and end of the lower-cased texts,
    and where each text's begin."""
    data = np.frombuffer(b"".join(START * ORDER + t.lower() + END for t in texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keys = data[: len(data) - ORDER].copy()
    for i in range(1, ORDER + 1):
        keys = (keys << np.uint64(8)) | data[i : len(data) - ORDER + i]
    starts = np.cumsum(sizes) - sizes
    if len(texts) > 1:
        inside = np.ones(len(keys), bool)
        ends = np.cumsum(sizes + ORDER)[:-1]
        for i in range(1, ORDER + 1):
            inside[ends - i] = False  # windows that reach into the next text
        keys = keys[inside]
    return keys, starts


def window_counts(docs: DataFrame) -> DataFrame:
    """(window, n) over all texts, summed per task before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in text_slices(batches, 4 << 20):
            waiting.append(np.unique(windows(byte_texts(batch))[0], return_counts=True))
            if sum(len(w[0]) for w in waiting) > 1_000_000:
                keys, n = _merged([(keys, n), *waiting])
                waiting = []
        keys, n = _merged([(keys, n), *waiting])
        for at in range(0, len(keys), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500_000].astype(np.int64)), pa.array(n[at : at + 500_000])], ["window", "n"])

    return docs.select("text").mapInArrow(counted, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class WindowTable:
    """The costs of windows in an open-addressing table, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slots, self.values = np.full(1 << self.bits, _EMPTY), np.zeros(1 << self.bits)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] == _EMPTY
            place, one = np.unique(at[todo][free], return_index=True)
            put = todo[free][one]
            self.slots[place], self.values[place] = keys[put], values[put]
            todo = todo[self.slots[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each window, 0 where the table has none, and which those are."""
        out, at = np.empty(len(keys)), self._slot(keys)
        found = self.slots[at]
        out[:] = self.values[at]
        odd = np.flatnonzero(found != keys)
        at = at[odd]
        missed = []
        while len(odd):
            gone = self.slots[at] == _EMPTY
            missed.append(odd[gone])
            odd, at = odd[~gone], (at[~gone] + 1) & ((1 << self.bits) - 1)
            hit = self.slots[at] == keys[odd]
            out[odd[hit]] = self.values[at[hit]]
            odd, at = odd[~hit], at[~hit]
        missed = np.concatenate(missed) if missed else np.zeros(0, np.int64)
        out[missed] = 0
        return out, missed


class ByteTrie(WindowTable):
    """The counts of every order, and what scoring needs per context.

    For the context h of order k + 1 and its suffix b of order k: ``below[k + 1]`` is the log10 of b's
    total without h's symbols plus escapes, ``escape_below`` the log10 cost of escaping b after h.
    """

    def __init__(self, tables: list[np.ndarray], counts: list[np.ndarray]):
        """Windows (sorted) and counts per order, shortest context first."""
        self.entries, self.logs, self.contexts, self.distinct, self.total, self.escape = [], [], [], [], [], []
        for keys, n in zip(tables, counts):
            context, first = np.unique(keys >> np.uint64(8), return_index=True)
            d = np.diff(np.concatenate([first, [len(keys)]]))
            t = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            self.entries.append(keys)
            self.logs.append(np.log10(np.maximum(n, 1)))
            self.contexts.append(context)
            self.distinct.append(d)
            self.total.append(t)
            self.escape.append(np.log10(np.maximum(d, 1)) - np.log10(np.maximum(t + d, 1)))
        self.below, self.escape_below = [np.zeros(0)], [np.zeros(0)]
        for k in range(1, len(self.entries)):
            keys, mask = self.entries[k], np.uint64((1 << (8 * k)) - 1)
            first = np.searchsorted(keys, self.contexts[k] << np.uint64(8))
            same = counts[k - 1][np.searchsorted(self.entries[k - 1], keys & mask)] if len(keys) else np.zeros(0, np.int64)
            taken = np.add.reduceat(same, first) if len(first) else np.zeros(0, np.int64)
            b = np.searchsorted(self.contexts[k - 1], self.contexts[k] & np.uint64((1 << (8 * (k - 1))) - 1))
            t, d = self.total[k - 1][b] - taken, self.distinct[k - 1][b] - self.distinct[k]
            self.below.append(np.log10(np.maximum(t + d, 1)))
            self.escape_below.append(np.where(d > 0, np.log10(np.maximum(d, 1)) - np.log10(np.maximum(t + d, 1)), 0.0))
        top = len(self.entries) - 1
        at = np.searchsorted(self.contexts[top], self.entries[top] >> np.uint64(8))
        super().__init__(self.entries[top], self.logs[top] - np.log10(np.maximum(self.total[top] + self.distinct[top], 1))[at])
        self.none = -np.log10(256 - (self.distinct[0][0] if len(self.distinct[0]) else 0))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, missed = super().look_up(keys)
        if len(missed):
            out[missed] = self._escaped(keys[missed])
        return out, missed[:0]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each window's symbol after its context."""
        return self.look_up(keys)[0]

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out, above = np.zeros(len(keys)), np.full(len(keys), -1)  # above: the known context one order up
        todo = np.arange(len(keys))
        for k in range(len(self.entries) - 1, -1, -1):
            key = keys[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            node, known = _find(self.contexts[k], key >> np.uint64(8))
            entry, seen = _find(self.entries[k], key)
            up = above[todo]
            fresh = known & (up < 0)
            base = np.zeros(len(todo))
            base[fresh] = np.log10(self.total[k][node[fresh]] + self.distinct[k][node[fresh]])
            after = known & (up >= 0)
            if after.any():
                base[after] = self.below[k + 1][up[after]]
            out[todo[seen]] += self.logs[k][entry[seen]] - base[seen]
            out[todo[fresh & ~seen]] += self.escape[k][node[fresh & ~seen]]
            if after.any():
                out[todo[after & ~seen]] += self.escape_below[k + 1][up[after & ~seen]]
            above[todo] = np.where(known, node, -1)
            todo = todo[~seen]
        out[todo] += self.none
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def order_counts(docs: DataFrame) -> list[DataFrame]:
    """(window, n) of every order over all texts, shortest context first."""
    orders = [staged(window_counts(docs), "windows")]
    for k in range(ORDER, 0, -1):
        orders.insert(0, orders[0].groupBy(F.col("window").bitwiseAND((1 << (8 * k)) - 1).alias("window")).agg(F.sum("n").alias("n")))
    return orders


def least_count(counts: DataFrame, nodes: int) -> int:
    """A count that at most ``nodes`` windows reach, about the least such; 1 if these are all. Counts are told by eighths of
    powers of two, some five hundred rows at any size, so windows of about equal counts stay in or out together."""
    eighth = F.floor(F.log2("n") * 8).alias("eighth")
    told = counts.groupBy(eighth).agg(F.count("*").alias("entries"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("eighth")).collect()
    held = np.cumsum([r.entries for r in told])
    if not len(held) or held[-1] <= nodes:
        return 1
    fitting = int(np.searchsorted(held, nodes, side="right"))
    return told[fitting - 1].least if fitting else told[0].most + 1


def trie_of(orders: list[DataFrame]) -> ByteTrie:
    kept = [c.toArrow() for c in orders]
    keys = [np.asarray(t.column("window")).astype(np.uint64) for t in kept]
    order = [np.argsort(k) for k in keys]
    return ByteTrie([k[o] for k, o in zip(keys, order)], [np.asarray(t.column("n")).astype(np.int64)[o] for t, o in zip(kept, order)])


def _suffix(column: str, size: int) -> Column:
    return F.col(column).bitwiseAND((1 << (8 * size)) - 1)


def _contexts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.shiftrightunsigned("window", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))


def known_costs(counts: DataFrame) -> DataFrame:
    """(window, n, cost) of all windows of the longest order."""
    base = _contexts(counts).select("context", F.log10(F.col("total") + F.col("distinct")).alias("base"))
    return counts.withColumn("context", F.shiftrightunsigned("window", 8)).join(base, "context").select("window", "n", (F.log10("n") - F.col("base")).alias("cost"))


def context_costs(orders: list[DataFrame], k: int) -> DataFrame:
    """(context, base, escape, below, escape_below) of order ``k``: the table of what ByteTrie knows per context."""
    base = F.log10(F.col("total") + F.col("distinct"))
    if k == 0:
        none = F.lit(None).cast("double")
        return _contexts(orders[0]).select("context", base.alias("base"), (F.log10("distinct") - base).alias("escape"), none.alias("below"), none.alias("escape_below"))
    shorter = orders[k - 1].select(F.col("window").alias("suffix"), F.col("n").alias("same"))
    own = orders[k].withColumn("suffix", _suffix("window", k)).join(shorter, "suffix").groupBy(F.shiftrightunsigned("window", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("same").alias("taken"),
    )
    after = _contexts(orders[k - 1]).select(F.col("context").alias("suffix"), F.col("total").alias("whole"), F.col("distinct").alias("symbols"))
    left = F.col("symbols") - F.col("distinct")
    below = F.log10(F.greatest(F.col("whole") - F.col("taken") + left, F.lit(1)))
    return own.withColumn("suffix", _suffix("context", k - 1)).join(after, "suffix").select(
        "context", base.alias("base"), (F.log10("distinct") - base).alias("escape"), below.alias("below"),
        F.when(left > 0, F.log10(left) - below).otherwise(0.0).alias("escape_below"),
    )


def window_costs(asked: DataFrame, known: DataFrame, orders: list[DataFrame]) -> DataFrame:
    """(window, cost) of the distinct windows ``asked``, by joins with all counts of every order.

    A key of a shuffled join has 65,536 windows at most, since they differ in two bytes only; what
    would have more (contexts of two bytes, windows of two) are tables of 65,536 rows at most, and broadcast.
    """
    first = staged(asked.join(known.select("window", "cost"), "window", "left"), "asked")
    orders = [*[staged(c, "order") for c in orders[:-1]], orders[-1]]
    none = F.lit(None).cast("double")
    walk = first.filter(F.col("cost").isNull()).select("window", F.lit(0.0).alias("cost"), none.alias("above"), none.alias("escape_above"), F.lit(False).alias("done"))
    for k in range(ORDER, -1, -1):
        entries = orders[k].select(F.col("window").alias("key"), F.log10("n").alias("hit"))
        contexts = context_costs(orders, k)
        walk = walk.withColumn("key", _suffix("window", k + 1)).withColumn("context", F.shiftrightunsigned("key", 8))
        # none of these windows is known in the longest order
        walk = walk.withColumn("hit", none) if k == ORDER else walk.join(F.broadcast(entries) if k < 2 else entries, "key", "left")
        walk = walk.join(F.broadcast(contexts) if k < 3 else contexts, "context", "left")
        step = F.when(F.col("hit").isNotNull(), F.col("hit") - F.coalesce("above", "base")).otherwise(F.coalesce("escape_above", "escape", F.lit(0.0)))
        walk = walk.select(
            "window", (F.col("cost") + F.when(F.col("done"), 0.0).otherwise(step)).alias("cost"), F.col("below").alias("above"),
            F.col("escape_below").alias("escape_above"), (F.col("done") | F.col("hit").isNotNull()).alias("done"),
        )
    rest = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.lit(float(256 - orders[0].count()))))
    return first.filter(F.col("cost").isNotNull()).unionByName(walk.select("window", (F.col("cost") + rest).alias("cost")))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, lower-cased A-Z; summed per task before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        size = 0
        for batch in text_slices(batches):
            for text in byte_texts(batch):
                seen.update(text.lower().split())
                size += len(text)
            if len(seen) > 1_000_000 or size > 256 << 20:  # the words are no longer than their texts
                yield from _pairs(seen)
                seen.clear()
                size = 0
        yield from _pairs(seen)

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(seen: Counter) -> Iterator[pa.RecordBatch]:
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def _per_text(keys: np.ndarray, starts: np.ndarray, missed: np.ndarray) -> pa.ListArray:
    """The distinct windows among ``missed`` of each text with how often it has them."""
    text = np.searchsorted(starts, missed, side="right") - 1
    both, times = np.unique((text.astype(np.uint64) << np.uint64(8 * (ORDER + 1))) | keys[missed], return_counts=True)
    offsets = np.searchsorted(both >> np.uint64(8 * (ORDER + 1)), np.arange(len(starts) + 1).astype(np.uint64))
    window = (both & np.uint64((1 << (8 * (ORDER + 1))) - 1)).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(window), pa.array(times, pa.int64())], ["window", "times"]))


_WORKER: dict[int, tuple] = {}


def _known_words(shared) -> dict[bytes, int]:
    """This worker's table of frequent words, kept between tasks."""
    key = id(shared.value)
    if key not in _WORKER:
        _WORKER.clear()
        words, n = shared.value
        _WORKER[key] = (dict(zip(words.split(b" "), n.tolist())) if len(n) else {}, shared.value)
    return _WORKER[key][0]


def score_documents(docs: DataFrame, held_out: Column, frequent: int = 1 << 18, nodes: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``
    (doc_id, text), learned from the rows where ``held_out`` is false.

    Both scores lower-case A-Z. A null text is empty: its one token is the end. Without training
    rows all words are unknown (N = V = 0) and every byte is equally likely. Repeated rows count
    and score as often as they occur; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    train = docs.filter(~held_out)
    orders = order_counts(train)
    least = least_count(orders[-1], nodes)  # no order has more windows than the longest
    if least == 1:
        trie = spark.sparkContext.broadcast(trie_of(orders))
    else:
        priced = staged(known_costs(orders[-1]), "costs")
        often = priced.filter(F.col("n") >= least).select("window", "cost").toArrow()
        trie = spark.sparkContext.broadcast(WindowTable(np.asarray(often.column("window")).astype(np.uint64), np.asarray(often.column("cost"))))
    counts = staged(word_counts(train), "words")
    told, ends = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first(), train.count()
    tokens, distinct = told.n + ends, told.v + (ends > 0)
    unit, end_log = float(np.log10(tokens + distinct + 1)), float(np.log10(ends + 1))
    # of short words many, of longer ones some, so that the table's bytes are bounded and a frequent ruler line is no hot key
    best = lambda words, most: words.orderBy(F.desc("n"), "word").limit(most)
    top = best(counts.filter(F.length("word") <= 64), frequent).unionByName(best(counts.filter(F.length("word").between(65, 4096)), frequent >> 8)).toArrow()
    table = spark.sparkContext.broadcast((b" ".join(top.column("word").to_pylist()), np.asarray(top.column("n")).astype(np.int64)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = _known_words(table), trie.value
        for batch in text_slices(batches, 1 << 20):
            texts = byte_texts(batch)
            keys, starts = windows(texts)
            costs, missed = model.look_up(keys)
            score = np.add.reduceat(costs, starts)
            n_tokens, n_known, logs, rare = [], [], [], []
            for text in texts:
                words = text.lower().split()
                n = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
                few = Counter(words[i] for i in np.flatnonzero(n == 0))
                n_tokens.append(len(words) + 1)
                n_known.append(int((n > 0).sum()) + (ends > 0))
                logs.append(float(np.log10(n + 1).sum()) + end_log)
                rare.append([{"word": w, "times": k} for w, k in few.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))), _per_text(keys, starts, missed)],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare", "windows"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out.alias("held_out"), "text")
    told = staged(read.mapInArrow(scored, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<struct<word: binary, times: long>>, windows array<struct<window: long, times: long>>"), "scored")
    rare = told.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    whole = told.drop("rare", "windows").join(more, "row", "left")
    if least > 1:
        odd = told.select("row", F.explode("windows").alias("w")).select("row", "w.window", "w.times")
        costs = window_costs(odd.select("window").distinct(), priced, orders)
        whole = whole.join(odd.join(costs, "window").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("more_score")), "row", "left")
        whole = whole.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score",
    )
