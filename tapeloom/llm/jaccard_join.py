"""Self-join of documents on the Jaccard similarity of their word n-grams, as a blocked sparse matrix
product.

1. *Classes.* Documents with the same n-gram set are one row of the incidence matrix. A first scan
   gives each document its set's size and 64-bit digest (class), and estimates which n-grams are
   frequent; these (at most ``hot`` of them) move to the end of the global n-gram order, which else
   is the order of their hashes. The order decides work, never results.
2. *Prefixes.* Sets whose similarity reaches the threshold share an n-gram among the first
   ``n - ceil(threshold * n) + 1`` of each, so only these columns are multiplied. A second scan
   emits them; columns with a single class are dropped, and of columns with equal classes all but
   one. The classes of a column are cut by size band first (sets whose sizes differ by more than
   the threshold cannot link) and then into parts of bounded weight, so a column that many classes
   share spreads over many tasks, one per pair of parts.
3. *Bounds.* Each class carries a parity bitmap of its set (n / 2 to n bits). Sets differ in at least
   as many n-grams as their bitmaps in bits, so a pair whose bitmaps differ more than
   ``n_a + n_b - 2 * least overlap`` is discarded without a look at its sets. A pair that several
   columns show stays in the one with most classes, and a class stays where a pair of its does.
4. *Blocks.* What stays is multiplied with whole sets: overlap counts accumulate over slices of
   n-grams, and rows leave as soon as no pair of theirs can still reach the least overlap,
   ``threshold / (1 + threshold) * (n_a + n_b)``. What remains is compared in exact integers.
5. *Components.* A block emits a spanning star per group and each class's number of links, not
   its pairs. Components come from
   large-star and small-star steps over the stars' edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import byte_texts, staged, text_slices, worker_keeps

#: Odd multipliers of a window's words (fixed values, any odd numbers do), repeating for longer windows.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Words that a worker keeps, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 150_000, 64
#: A class weighs its n-grams in a seat, but this at least.
LEAST_WEIGHT = 1_000
#: n-grams that a task sees once are told with this chance, and then count as that many.
THINNED = 4


class WordHashes(dict):
    """Word -> 64-bit hash, kept between texts up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def shingles(text: bytes, width: int) -> np.ndarray:
    """The set of ``width``-word windows of a text (A-Z lower-cased) as sorted 64-bit hashes; a shorter
    text is one window."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(worker_keeps("word hashes", WordHashes).__getitem__, words), np.uint64, len(words))
    n, m = max(1, len(a) - width + 1), min(width, len(a))
    h = np.zeros(n, np.uint64)
    for k in range(m):
        h += a[k : k + n] * (_MIX[k % len(_MIX)] + np.uint64(2 * (k // len(_MIX))))
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def parity(found: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set in 64-bit words: per bit, whether an odd number of n-grams fall on it."""
    words = 1
    while 128 * words < len(found):
        words *= 2
    at = (found % np.uint64(64 * words)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view("<u8")


def digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _least(n, percent: int):
    """Smallest overlap of a set of size n with a set that is similar enough: ceil(threshold * n)."""
    return -(-percent * n // 100)


def prefix(found: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The first n-grams of a set in the global order: by hash, the hot ones last by heat."""
    n = len(found)
    p = n - _least(n, percent) + 1 if n else 0
    if not len(hot):
        return found[:p]
    at = np.minimum(np.searchsorted(hot["gram"], found), len(hot) - 1)
    warm = hot["gram"][at] == found
    cold = found[~warm][:p]
    if len(cold) == p:
        return cold
    late = np.flatnonzero(warm)
    late = late[np.lexsort((found[late], hot["heat"][at[late]]))]
    return np.concatenate([cold, found[late[: p - len(cold)]]])


_HOT = np.dtype([("gram", np.uint64), ("heat", np.int64)])


def first_scan(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (hot=false, doc_id, key=class, n=set size, bits=parity bitmap) per document and rows (hot=true, key=n-gram,
    n=estimated count among prefixes) for n-grams that may be frequent."""
    none = np.zeros(0, _HOT)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams, held = set(), [], []

        def told(keys, n, ids, bits):
            return pa.RecordBatch.from_arrays([pa.array([bits is None] * len(keys), pa.bool_()), ids, pa.array(keys, pa.int64()), pa.array(n, pa.int64()), bits or pa.nulls(len(keys), pa.binary())], ["hot", "doc_id", "key", "n", "bits"])

        kind = None
        for batch in text_slices(batches, 2 << 20):
            kind = batch.column("doc_id").type
            keys, sizes, bits = [], [], []
            for text in byte_texts(batch):
                found = shingles(text, width)
                keys.append(digest(found))
                sizes.append(len(found))
                bits.append(parity(found).tobytes())
                if keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(prefix(found, percent, none))
            yield told(keys, sizes, batch.column("doc_id"), pa.array(bits, pa.binary()))
            if sum(map(len, held)) > 2_000_000:
                grams.append(_counted(held))
                held = []
        if kind is not None:
            grams.append(_counted(held))
            u = np.concatenate([g[0] for g in grams])
            u, at = np.unique(u, return_inverse=True)
            n = np.bincount(at, np.concatenate([g[1] for g in grams]), len(u)).astype(np.int64)
            salt = np.uint64(xxhash.xxh3_64_intdigest(str(sorted(seen)[:1])))
            once = ((u ^ salt) * _MIX[1]) >> np.uint64(62) == 0
            keep = (n > 1) | once
            u, n = u[keep], np.where(n > 1, n, THINNED)[keep]
            yield told(u.view(np.int64), n, pa.nulls(len(u), kind), None)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"hot boolean, doc_id {kind}, key long, n long, bits binary")


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)


def prefix_entries(docs: DataFrame, width: int, percent: int, hot) -> DataFrame:
    """(gram, class, n) for the prefix of every document's set. A set so small that only its equals are
    similar enough (with one n-gram more it is not) has no links beyond its class and no entries."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches, 2 << 20):
            grams, keys, sizes = [], [], []
            for text in byte_texts(batch):
                found = shingles(text, width)
                key = digest(found)
                if 100 * len(found) >= percent * (len(found) + 1) and key not in seen:
                    seen.add(key)
                    grams.append(prefix(found, percent, hot.value))
                    keys.append(key)
                    sizes.append(len(found))
            if grams:
                each = [len(g) for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int64), each))], ["gram", "class", "n"])

    return docs.select("text").mapInArrow(emitted, "gram long, class long, n long")


def _weight(n: Column) -> Column:
    """What a class adds to a seat: its n-grams, and at least as much as keeps a seat's pairs few."""
    return F.greatest(n, F.lit(LEAST_WEIGHT))


def open_columns(entries: DataFrame, percent: int) -> DataFrame:
    """The entries (gram, class, n, load) of columns with two classes at least whose sizes allow a link; of
    columns with equal classes one. ``load`` is the column's weight. An entry may come twice."""
    mark = F.xxhash64("class").bitwiseAND((1 << 40) - 1)
    columns = entries.groupBy("gram").agg(
        F.count("*").alias("d"), F.sum(mark).alias("classes"), F.min("class").alias("lo"), F.max("class").alias("hi"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.sum(_weight(F.col("n"))).alias("load"),
    ).filter((F.col("lo") != F.col("hi")) & ((F.col("d") > 2) | (100 * F.col("least") >= percent * F.col("most"))))
    columns = columns.groupBy("d", "classes", "lo", "hi", "load").agg(F.min("gram").alias("gram")).select("gram", "load")
    return staged(entries.join(columns, "gram"), "open")


def seats(opened: DataFrame, percent: int, weight: int) -> DataFrame:
    """(seat, gram, side, class, n): every class of a column in the seats that let it meet all others it
    may link with. A column of at most ``weight`` is one seat. Of a heavier one a seat is a pair of parts of
    about ``weight`` at most, of one size band (side 2 where a part meets itself, else 0 and 1) or of two
    adjacent ones."""
    light = opened.filter(F.col("load") <= weight).select(F.xxhash64("gram").alias("seat"), "gram", F.lit(2).alias("side"), "class", "n")
    banded = opened.filter(F.col("load") > weight).drop("load").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("long"))
    load = banded.groupBy("gram", "band").agg(F.greatest(F.lit(1), F.ceil(F.sum(_weight(F.col("n"))) / weight)).cast("int").alias("k"))
    near = load.select("gram", F.col("band").alias("at"), F.col("k").alias("parts"))
    own = F.pmod(F.xxhash64("class", "gram"), F.col("k")).cast("int")
    home = banded.join(load, ["gram", "band"]).select("gram", "class", "n", "band", own.alias("own"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("at"))
    met = home.join(near, ["gram", "at"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lower = (F.col("band") < F.col("at")) | ((F.col("band") == F.col("at")) & (F.col("own") <= F.col("other")))
    same = (F.col("band") == F.col("at")) & (F.col("own") == F.col("other"))
    first, second = F.struct("band", F.col("own").cast("long")), F.struct("at", F.col("other").cast("long"))
    heavy = met.select(
        F.when(lower, F.xxhash64("gram", first, second)).otherwise(F.xxhash64("gram", second, first)).alias("seat"), "gram",
        F.when(same, 2).when(lower, 0).otherwise(1).alias("side"), "class", "n",
    )
    return light.unionByName(heavy)


def _pairs(sizes: np.ndarray, limit: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside each of the consecutive runs of these sizes, in portions."""
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 1]):
        runs = starts[sizes == d]
        i, j = np.triu_indices(int(d), 1)
        step = max(1, limit // len(i))
        for at in range(0, len(runs), step):
            part = runs[at : at + step, None]
            yield (part + i).ravel(), (part + j).ravel()


def bounded_seats(placed: DataFrame, percent: int) -> DataFrame:
    """The rows of (seat, gram, side, class, n, bits) that have a pair within the bitmaps' bound. With a column
    ``wider`` (the class's columns that are wider than this one), of these only pairs without a wider column in
    common count, so each pair stays in its widest column alone."""
    ranked = "wider" in placed.columns

    def kept(seat, side, key, n, bits, wider) -> np.ndarray:
        words = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        own: dict[int, np.ndarray] = {}
        slot = np.zeros(len(bits), np.int64)
        for w in np.unique(words):
            at = np.flatnonzero(words == w)
            slot[at] = np.arange(len(at))
            own[w] = np.frombuffer(b"".join(bits[k] for k in at), "<u8").reshape(len(at), w)
        cuts = np.flatnonzero(np.concatenate([[True], seat[1:] != seat[:-1], [True]]))
        stays = np.zeros(len(bits), bool)
        for i, j in _pairs(np.diff(cuts)):
            fits = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (key[i] != key[j]) & ((side[i] == 2) | (side[i] != side[j]))
            i, j = i[fits], j[fits]
            swap = words[i] < words[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)  # i has the longer bitmap
            total = n[i] + n[j]
            most = total - 2 * -(-percent * total // (100 + percent))
            for w in np.unique(words[j]):
                for v in (w, 2 * w):
                    at = np.flatnonzero((words[j] == w) & (words[i] == v))
                    for k in range(0, len(at), max(1, 1_000_000 // v)):  # a portion's bitmaps take 8 MB a side
                        p = at[k : k + max(1, 1_000_000 // v)]
                        a = own[v][slot[i[p]]]
                        a = a if v == w else a[:, :w] ^ a[:, w:]
                        good = p[np.bitwise_count(a ^ own[w][slot[j[p]]]).sum(1, dtype=np.int64) <= most[p]]
                        if ranked:
                            good = good[[wider[x].isdisjoint(wider[y]) for x, y in zip(i[good].tolist(), j[good].tolist())]] if len(good) else good
                        stays[i[good]] = True
                        stays[j[good]] = True
        return stays

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last seat, which may go on
        for batch in _with_end(batches):
            rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks().to_batches() if rest is not None or batch is not None else []
            if not rows:
                continue
            rows = rows[0]
            seat = rows.column("seat").to_numpy()
            end = len(seat) if batch is None else int(np.searchsorted(seat, seat[-1]))
            done, rest = rows.slice(0, end), rows.slice(end)
            if end:
                col = lambda c: done.column(c).to_numpy()
                wider = [set(w) for w in done.column("wider").to_pylist()] if ranked else None
                stays = kept(col("seat"), col("side"), col("class"), col("n"), done.column("bits").to_pylist(), wider)
                yield done.filter(pa.array(stays)).select(["seat", "gram", "side", "class", "n"])

    ordered = placed.repartition("seat").sortWithinPartitions("seat")
    return ordered.mapInArrow(bounded, "seat long, gram long, side int, class long, n long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def with_columns(kept: DataFrame) -> DataFrame:
    """``kept`` (seat, gram, .., class, ..) with ``d``, the classes of the row's column, and ``columns``, all columns
    (d, gram) of its class: at most as many as its prefix has n-grams."""
    pairs = kept.select("gram", "class").distinct()
    wide = pairs.groupBy("gram").agg(F.count("*").alias("d"))
    lists = pairs.join(wide, "gram").groupBy("class").agg(F.collect_list(F.struct("d", "gram")).alias("columns"))
    return kept.join(wide, "gram").join(lists, "class")


def block_links(sets: list[np.ndarray], percent: int, slice_grams: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with 100 * overlap >= percent * union: overlap counts accumulate over
    slices of n-grams, rows without a reachable pair leave between slices."""
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    cuts = np.searchsorted(column, np.arange(0, width + slice_grams, slice_grams))
    live = np.arange(len(sets))
    rest = np.bincount(owner, minlength=len(sets))
    counts = np.zeros((len(sets), len(sets)), np.int64)
    for s in range(len(cuts) - 1):
        part = slice(cuts[s], cuts[s + 1])
        rest -= np.bincount(owner[part], minlength=len(rest))
        place = np.full(len(sets), -1)
        place[live] = np.arange(len(live))
        inside = place[owner[part]] >= 0
        dense = np.zeros((len(live), min(slice_grams, width - s * slice_grams)), np.float32)
        dense[place[owner[part]][inside], column[part][inside] - s * slice_grams] = 1
        counts += (dense @ dense.T).astype(np.int64)
        n, r = sizes[live], rest[live]
        reach = counts + np.minimum(r[:, None], r[None, :])
        able = (100 + percent) * reach >= percent * (n[:, None] + n[None, :])
        np.fill_diagonal(able, False)
        keep = able.any(axis=1)
        if not keep.all():
            live, counts = live[keep], counts[np.ix_(keep, keep)]
        if not len(live):
            break
    n = sizes[live]
    linked = np.triu((100 + percent) * counts >= percent * (n[:, None] + n[None, :]), 1)
    i, j = np.nonzero(linked)
    return live[i], live[j]


def link_classes(kept: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, other, links): per seat a star's edges (other is the class itself in rows that only carry a
    count) and each class's links to documents, ``sets`` being (class, copies, grams)."""
    rows = kept.join(sets, "class").select("seat", "gram", "side", "class", "copies", "wider", "grams")

    def multiply(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class", kind="stable")
        classes, copies, side = frame["class"].to_numpy(), frame["copies"].to_numpy(), frame["side"].to_numpy()
        i, j = block_links([np.frombuffer(g, np.uint64) for g in frame["grams"]], percent)
        # a pair is counted in one seat of one column: the widest that both are in
        mine = (side[i] == 2) | (side[i] != side[j])
        wider = [set(w) for w in frame["wider"]]
        mine &= np.fromiter((m and wider[a].isdisjoint(wider[b]) for m, a, b in zip(mine, i, j)), bool, len(i))
        links = np.bincount(i[mine], copies[j[mine]], len(classes)) + np.bincount(j[mine], copies[i[mine]], len(classes))
        root = np.arange(len(classes))
        while len(i):  # smallest row of each group
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            if (root == before).all():
                break
        told = np.flatnonzero((root != np.arange(len(root))) | (links > 0))
        return pd.DataFrame({"class": classes[told], "other": classes[root[told]], "links": links[told].astype(np.int64)})

    return rows.groupBy("seat").applyInPandas(multiply, "class long, other long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): the smallest node of each component, for nodes with an edge.

    Large-star gives every larger neighbour of a node to its smallest neighbour, small-star every
    smaller one; repeated in turn, until nothing changes, they end in one star per component.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large.filter("a <> b"), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(edges, "small")
        told = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1)).alias("mark")).first()
        if told == seen:
            break
        seen = told
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, hot: int = 1 << 20, heat: int = 8, weight: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * common n-grams >= ``percent`` * union of n-grams (``width`` words);
    component_id is the smallest doc_id that links reach, n_links the number of other documents
    (rows) that a document links with. A null or blank text has no n-grams and links with nothing; its
    component is its own id. A null doc_id joins in but names no component unless nothing else
    can (then null). Repeated rows link with each other. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    scan = staged(first_scan(docs, width, percent), "scan")
    told = scan.filter("hot").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= heat).orderBy(F.desc("n"), "key").limit(hot).toArrow()
    table = np.zeros(told.num_rows, _HOT)
    table["gram"], table["heat"] = np.asarray(told.column("key")).astype(np.int64).view(np.uint64), np.log2(np.maximum(np.asarray(told.column("n")), 1)).astype(np.int64)
    late = spark.sparkContext.broadcast(np.sort(table, order="gram"))

    marked = scan.filter("not hot").select("doc_id", F.col("key").alias("class"), F.col("n").alias("n_shingles"))
    bits = scan.filter("not hot and n > 0").groupBy(F.col("key").alias("class")).agg(F.first("bits").alias("bits"))
    opened = open_columns(prefix_entries(docs, width, percent, late), percent)
    placed = seats(opened, percent, weight).join(bits, "class").select("seat", "gram", "side", "class", "n", "bits")
    near = with_columns(staged(bounded_seats(placed, percent), "bounded"))
    above = F.transform(F.filter("columns", lambda c: (c["d"] > F.col("d")) | ((c["d"] == F.col("d")) & (c["gram"] > F.col("gram")))), lambda c: c["gram"])
    near = staged(near.select("seat", "gram", "side", "class", "n", above.alias("wider")), "near")
    kept = bounded_seats(near.join(bits, "class").select("seat", "gram", "side", "class", "n", "bits", "wider"), percent)
    kept = staged(kept.join(near.select("seat", "class", "wider").distinct(), ["seat", "class"]), "kept")
    firsts = marked.join(kept.select("class").distinct(), "class").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    sets = class_sets(docs, firsts, width)
    found = staged(link_classes(kept, sets, percent), "links")

    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    per_class = marked.filter("n_shingles > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    per_class = staged(per_class.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").join(links, "class", "left").withColumn("root", F.coalesce("root", "class")), "classes")
    named = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = per_class.join(named, "root").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = marked.filter("n_shingles > 0").join(per_class, "class").select("doc_id", "n_shingles", "component_id", "n_links")
    alone = marked.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def class_sets(docs: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """(class, copies, grams): the whole sets of the classes in ``firsts`` (class, copies, doc_id), from the
    text of each one's smallest document (or, where ids are null, of any)."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    texts = docs.select(named, "text").join(firsts.select(named).distinct(), "name", "left_semi")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches, 2 << 20):
            keys, grams = [], []
            for text in byte_texts(batch):
                found = shingles(text, width)
                key = digest(found)
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    grams.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], ["class", "grams"])

    # a task makes a class once; of those that several tasks make one is kept
    made = texts.select("text").mapInArrow(built, "class long, grams binary").groupBy("class").agg(F.first("grams").alias("grams"))
    return made.join(firsts.select("class", "copies"), "class")
