"""SimHash components, the Merkle manifest and importance resampling against plain versions of each."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import merkle, resampling, simhash
from tapeloom.llm.common import positions, split_words, xxh64
from tests.llm.test_operators import FOLDER, ODD, SCHEMA, docs, none, odd, rows_of  # noqa: F401

NUMBERED = "doc_id long, source string, lang string, n_chars long, text string, digest string, g string, pos long, total int, fp long, seat string, able int, all string, root string"


def test_hashes_equal_the_library():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4000).astype(np.uint8).tobytes()
    starts, lengths = rng.integers(0, 3900, 3000), rng.integers(0, 90, 3000)
    for seed in (0, 42):
        want = [xxhash.xxh64_intdigest(data[s : s + n], seed) for s, n in zip(starts.tolist(), lengths.tolist())]
        assert xxh64(data, starts, lengths, seed).tolist() == want


def test_split_words():
    texts = [b"", b"  A b\tC ", b"\n", b"x", "é É".encode()]
    data, starts, ends, counts = split_words(texts, simhash._TABLE)
    assert counts.tolist() == [0, 3, 0, 1, 2]
    assert [data[a:b] for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"x", "é".encode(), "É".encode()]
    assert split_words([], simhash._TABLE)[3].tolist() == [] and split_words([b""], simhash._TABLE)[3].tolist() == [0]


def test_positions_count_within_groups(spark):
    rows = [("a" if k % 3 else "b", k * 7 % 50) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, x long").repartition(4)
    got = [(r.g, r.x, r.pos, r.total) for r in positions(frame, ["g"], [F.col("x").desc()], "p").collect()]
    for g in "ab":
        mine = sorted((p, x) for h, x, p, _ in got if h == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted((x for h, x in rows if h == g), reverse=True)
        assert {n for h, _, _, n in got if h == g} == {len(mine)}


# --- 11: SimHash ------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, most=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return collections.Counter((ids[i], f"{prints[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(ids)))


def components_of(frame, **how):
    return collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.simhash_components(frame, **how)))


def test_simhash_equals_brute_force(odd, none, docs):  # noqa: F811
    assert components_of(odd) == brute_components([r[0] for r in ODD], [brute_print(r[1]) for r in ODD])
    assert components_of(none) == collections.Counter()
    rows = docs.select("doc_id", "text").collect()
    assert components_of(docs) == brute_components([r.doc_id for r in rows], [brute_print(r.text) for r in rows])


@pytest.mark.parametrize("part", [50, 1024])
def test_large_seats_and_parts_lose_no_link(spark, part):
    """Balls of near fingerprints around few centres, more than a seat holds, given as prints."""
    rng = np.random.default_rng(part)
    centres = rng.integers(0, 1 << 63, 3, np.uint64)
    prints = {0, (1 << 64) - 1}
    for k in range(600):
        p = int(centres[k % 3])
        for b in rng.integers(0, 64 if k % 5 == 0 else 9, int(rng.integers(0, 9))):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    for masks in (simhash.segment_masks(10, 4), simhash.segment_masks(10**9, 4)):
        edges = simhash.components(simhash.linked(simhash.dealt(frame, masks, part), 4)).collect()
        group = {e.node: e.root for e in edges}
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        want = {(i, c) for (i, _, c) in brute_components(signed, prints)}
        least = collections.defaultdict(list)
        for s in signed:
            least[group.get(s, s)].append(s)
        assert {(s, min(least[group.get(s, s)])) for s in signed} == want


def test_masks_share_one_for_every_pair_within_the_bound():
    rng = np.random.default_rng(4)
    for n in (100, 10**7, 10**10):
        masks = simhash.segment_masks(n, 4)
        for _ in range(300):
            change = sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any(change & m % (1 << 64) == 0 for m in masks)
    assert len(simhash.segment_masks(10**10, 4)) > len(simhash.segment_masks(100, 4))


# --- 12: Merkle manifest --------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fan=8):
    def code(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    nodes = []
    for r in rows:
        leaf = H(*(code(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        other = dict(r, text=r["text"].translate(small) if r["text"] is not None else None)
        nodes.append((r["lang"], r["doc_id"], leaf, H(*(code(other[c]) for c in ("doc_id", "source", "lang", "n_chars", "text"))) if hit else leaf))

    def tree(level):
        """Root, and per leaf its (left, right) siblings by level."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, p in enumerate(paths):
                s = at[k] - at[k] % fan
                p.append(("".join(level[s : at[k]]), "".join(level[at[k] + 1 : s + fan])))
                at[k] //= fan
            level = [H(*level[k : k + fan]) for k in range(0, len(level), fan)]
        return level[0], paths

    def fold(node, path):
        for left, right in path:
            node = H(left, node, right)
        return node

    langs = sorted({n[0] for n in nodes}, key=lambda v: (v is not None, (v or "").encode()))
    mine = {v: sorted((n for n in nodes if n[0] == v), key=lambda n: (n[1] is not None, n[1] or 0, n[2])) for v in langs}
    trees = {v: tree([n[2] for n in mine[v]]) for v in langs}
    if not langs:
        return collections.Counter()
    root, tops = tree([trees[v][0] for v in langs])
    out = collections.Counter()
    for v, top in zip(langs, tops):
        for n, path in zip(mine[v], trees[v][1]):
            folded = fold(n[3], path + top)
            out[(n[1], n[2], trees[v][0], root, H(*(x + y for x, y in path + top)), folded, folded == root)] += 1
    return out


def manifest(frame, **how):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return collections.Counter(tuple(r[c] for c in cols) for r in rows_of(merkle.merkle_manifest(frame, **how)))


def plain(frame):
    return [r.asDict() for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_equals_brute_force(odd, none, docs):  # noqa: F811
    for frame in (odd, none, docs):
        assert manifest(frame) == brute_manifest(plain(frame))


def test_manifest_of_odd_trees(spark):
    """Runs of one node, groups of one leaf, many groups, a table of one row; other columns have the names used inside."""
    sizes = {None: 65, "": 1, "é": 9, **{f"l{k:02}": 1 + k % 3 for k in range(20)}}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i, "s", lang, i, f"Text {i}", "d", "g", 0, 0, 0, "s", 1, "a", "r"))
            i += 1
    frame = spark.createDataFrame(rows, NUMBERED).repartition(5)
    got = manifest(frame)
    assert got == brute_manifest(plain(frame)) and 0 < sum(v for k, v in got.items() if not k[-1]) < len(rows)
    one = frame.filter("doc_id = 3")
    assert manifest(one) == brute_manifest(plain(one))
    assert manifest(frame, fan=3) == brute_manifest(plain(frame), fan=3)


# --- 13: importance resampling -----------------------------------------------------------------------


def features(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return len(words), collections.Counter(zlib.crc32(g.encode()) % 10_000 for g in grams)


def brute_resample(rows, target, percent):
    found = [(i, *features(t)) for i, t in rows]
    s, t = (sum((f for *_, f in fs), collections.Counter()) for fs in (found, [features(x) for x in target]))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in s}
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in f.items())
        out.append((i, n, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranked = [(r[0], *r[2:], k + 1) for k, r in enumerate(drawn)]
    rest = collections.Counter((r[0], *r[2:], None) for r in out) - collections.Counter((*r[:-1], None) for r in ranked)
    return collections.Counter(ranked) + rest


def resampled(frame, target, **how):
    return collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows_of(resampling.resample(frame, target, **how)))


def test_resampling_equals_brute_force(spark, odd, none, docs):  # noqa: F811
    target = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    texts = [r.text for r in target.select("text").collect()] + [None, ""]
    more = target.select("text").unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    for frame, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [r[:2] for r in ODD]), (none, [])):
        for percent in (5, 50):
            assert resampled(frame, more, percent=percent) == brute_resample(rows, texts, percent)
    assert resampled(odd, none) == brute_resample([r[:2] for r in ODD], [], 5)


def test_tables_verify_bytes(monkeypatch):
    """Equal keys never join different n-grams, and long texts take several tables."""
    monkeypatch.setattr(resampling, "xxh64", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(resampling, "PORTION", 7)
    texts = [b"one two three one two three four", b"", b"one two", ("w" * 300 + " x").encode(), b"threex threey threez"]
    _, tables = resampling.interned(texts, 3)
    got = collections.Counter()
    for table, text in tables:
        buckets = table.buckets(10_000)
        assert table.counts.sum() == len(text)
        got.update(zip(text.tolist(), buckets[table.ids].tolist()))
    want = collections.Counter()
    for k, t in enumerate(texts):
        want.update({(k, b): n for b, n in features(t.decode())[1].items()})
    assert got == want
