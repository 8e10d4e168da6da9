"""Each text operator against brute force, and on rows that are null, empty, long, tied or repeated."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import fingerprints, jaccard_join, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, token_counts, url_trust
from tapeloom.llm.common import fold
from tapeloom.llm.features import Text, repeated_words
from tapeloom.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, seat long, class string, rank int, word string"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions under a pale winter moon and nobody asks why"
ODD = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.upper(), None, None),
    (4, BASE.replace("moon", "sun"), "en", "b"), (5, None, "fr", "b"), (6, "", None, "c"), (7, " \n\t ", "fr", None),
    (8, "le chat noir dort sur la chaise près de la fenêtre " * 3, "fr", "c"), (9, "a", "en", "a"), (10, "un deux trois", "fr", "b"),
    (11, "<|endoftext|> and  <|startoftext|>\u2003x\u0085y 'll 𝔘nicode ÀÉ", "en", "a"), (12, "word " * 30_000, "en", "a"),
    (None, "no id here but some words of text to count", None, "a"), (13, "x" * 50_000, None, "b"), (14, BASE + " " + BASE[:40], "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, None, k, 0, "c", 1, "w") for k, (i, t, lang, s) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def key(r):
    return str(sorted(r.items(), key=str))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER) == ""


# --- 1: n-gram Jaccard join ---------------------------------------------------------------


def brute_join(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows)))


def joined(frame, **how):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in rows_of(jaccard_join.jaccard_join(frame, **how)))


def test_join_equals_brute_force(odd, none, docs):
    assert joined(odd) == brute_join([(i, t) for i, t, *_ in ODD], 4, 85)
    assert joined(none) == collections.Counter()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs) == brute_join(rows, 4, 85)


@pytest.mark.parametrize("weight,hot,heat", [(15_000, 64, 2), (1_000_000, 1 << 18, 4)])
def test_join_of_large_groups(spark, weight, hot, heat):
    """Hundreds of near copies, split over many parts, with a passage that all share."""
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(120)]
        for c in range(60):
            w = list(base)
            for k in rng.integers(0, 120, int(rng.integers(0, 5))):
                w[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((int(len(rows)), " ".join((passage if c % 2 else []) + w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(frame, weight=weight, hot=hot, heat=heat) == brute_join(rows, 4, 85)


def test_links_of_copies_read_by_several_tasks(spark, tmp_path):
    near = BASE.replace("moon", "sun")
    rows = [(1, BASE)] * 4 + [(2, near), (None, BASE), (None, near)]
    for r in rows:
        spark.createDataFrame([r], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task per file
    try:
        frame = spark.read.parquet(str(tmp_path / "docs"))
        assert frame.rdd.getNumPartitions() == len(rows)
        assert joined(frame, percent=60) == brute_join(rows, 4, 60)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_block_links_drop_rows_early():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[:-2], [np.uint64(1000 + k)]])) for k, s in enumerate(sets)]
    for cut in (16, 4096):
        i, j = jaccard_join.block_links(sets, 80, cut)
        want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in jaccard_join.components(edges).collect()} == {(k, 0) for k in range(1, 61)} | {(101, 100)}


# --- 2: packing ---------------------------------------------------------------------------


def test_packing_equals_the_tokenizer(odd, none, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)

    def want(rows):
        out = collections.Counter()
        for i, t in rows:
            ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            for k, at in enumerate(range(0, len(ids), 2048)):
                out[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
        return out

    for frame, rows in ((odd, [(i, t) for i, t, *_ in ODD]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = rows_of(packing.pack_documents(frame, path))
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want(rows)
        places = collections.defaultdict(list)
        for r in got:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in places.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert rows_of(packing.pack_documents(none, path)) == []


def test_exchange_saves_sequences(spark):
    """Small partitions leave gaps; exchanging their documents closes most of them."""
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(k, int(n)) for k, n in enumerate(rng.integers(1, 1000, 3000))], "row long, length long")
    total = items.agg(F.sum("length")).first()[0]
    one, many = ({r.row: (r.sequence, r.offset) for r in packing.pack_items(items, 1000, part_items=200, rounds=n).collect()} for n in (1, 6))
    count = lambda x: len({s for s, _ in x.values()})
    assert len(one) == len(many) == 3000
    assert -(-total // 1000) <= count(many) < count(one)


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(1, 100, int(rng.integers(1, 40)))
        bins, offsets, left = packing.best_fit(lengths, 100)
        assert (np.bincount(bins, lengths) <= 100).all() and (left >= 0).all()
        assert packing.lower_bound(lengths, 100) <= len(left)
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2


# --- 3: languages -------------------------------------------------------------------------


def test_languages(odd, none, docs):
    got = rows_of(language_id.languages(docs, fold(F.col("doc_id"), 3, 1)))
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in true if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.95
    got = rows_of(language_id.languages(odd, F.lit(False)))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (1, 8, 5, 6, 7)] == ["en", "fr", "und", "und", "und"]
    assert rows_of(language_id.languages(none, F.lit(False))) == []
    assert {r["lang_pred"] for r in rows_of(language_id.languages(odd, F.lit(True)))} == {"und"}


def test_filter_answers_for_many_languages():
    known = language_id.LanguageFilter([f"l{k:02d}" for k in range(70)], 16, 2)
    keys = np.arange(70 * 50, dtype=np.int64) * 7919
    for k in range(70):
        known.insert(k, keys[50 * k : 50 * k + 50])
    known.close()
    counts = known.counts(keys, np.arange(0, 70 * 50 + 1, 50))
    assert (counts.argmax(axis=1) == np.arange(70)).all() and np.allclose(counts.max(axis=1), 50, atol=1)


# --- 4: token counts ----------------------------------------------------------------------


@pytest.mark.parametrize("entries", [1, 65_536])
def test_token_counts_equal_the_tokenizer(odd, none, docs, entries, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for frame, rows in ((odd, [(i, t) for i, t, *_ in ODD]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(token_counts.count_tokens(frame, path, 512, entries)))
        n = {t: len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
        assert got == collections.Counter((i, len((t or "").encode()), n[t], n[t] > 512) for i, t in rows)
    assert rows_of(token_counts.count_tokens(none, path)) == []


# --- 5: mixing ----------------------------------------------------------------------------


def test_targets_equal_the_iteration(spark):
    rng = np.random.default_rng(2)
    sizes = [(None, 50), *((f"s{k:02d}", int(n)) for k, n in enumerate([0, 1, 10_000, *rng.integers(1, 900, 20)]))]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in sizes if s is not None)) + [None]
    size, weight = dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    held: set = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in held)
        share = rest / sum(weight[s] for s in order if s not in held)
        target = {s: 3.0 * size[s] if s in held else share * weight[s] for s in order}
        new = {s for s in order if s not in held and target[s] > 3 * size[s]}
        if not new:
            break
        held |= new
    assert all(math.isclose(got[s], target[s], abs_tol=1e-6) for s in order) and held


def test_mixing(odd, none, docs):
    for frame in (odd, docs):
        got = rows_of(mixing.mix_sources(frame))
        assert len(got) == frame.count()
        for source in {r["source"] for r in got}:
            part = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= max(r["size"] for r in part)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert sorted(map(key, got)) == sorted(map(key, rows_of(mixing.mix_sources(frame.repartition(4)))))
    assert rows_of(mixing.mix_sources(none)) == []


# --- 6: fingerprints ----------------------------------------------------------------------


def test_fingerprints(odd, none, docs):
    for frame in (docs, odd):
        rows = [(r.doc_id, r.text or "", r.mark) for r in frame.select("doc_id", "text", F.xxhash64("text").alias("mark")).collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        want = collections.Counter()
        for k, (i, t, _) in enumerate(rows):
            n, q = rows[(k + 1) % len(rows)][1], len(t) // 4
            want[i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()] += 1
        got = rows_of(fingerprints.fingerprint_documents(frame, chunk_rows=7))
        assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        text = {i: t for i, t, _ in rows}
        prints = collections.defaultdict(set)
        for r in got:
            prints[text[r["doc_id"]]].add(r["fingerprint"])
        assert all(len(p) == 1 for p in prints.values())
        if frame is docs:
            long = [r for r in got if r["n_chars"] > 1000]
            assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in long])
    assert rows_of(fingerprints.fingerprint_documents(none)) == []


def test_entropy_classes_equal_counting():
    data = np.frombuffer(b"".join(fingerprints.padded(t.encode()) for t in (BASE, "aaaa", "abcabc" * 40)), np.uint8)
    got = fingerprints.entropy_classes(data)
    for at in range(0, len(data) - fingerprints.WINDOW + 1, 5):
        n = np.bincount(data[at : at + fingerprints.WINDOW])
        assert abs((n[n > 0] * np.log2(n[n > 0])).sum() * 2 - got[at]) <= 1.01


# --- 7: quality rules ---------------------------------------------------------------------


def test_repeated_words_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        words = [b"%d" % k for k in rng.integers(0, 3, int(rng.integers(0, 60)))]
        seen = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {p for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert repeated_words(words) == len(covered)


def test_rules_keep_the_same_in_any_order(odd, none, docs):
    for frame in (odd, docs):
        got = rows_of(quality_rules.judge_quality(frame))
        assert len(got) == frame.count()
        texts = {(r.doc_id, r.text) for r in frame.collect()}
        verdict = {i: not any(r.rejects(Text(t)) for r in quality_rules.BASE + quality_rules.EXTRA) for i, t in texts}
        assert all(r["kept"] == verdict[r["doc_id"]] for r in got)
        kept = rows_of(quality_rules.keep_good(frame))
        assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(r.doc_id for r in frame.collect() if verdict[r.doc_id])
    assert rows_of(quality_rules.judge_quality(none)) == [] and rows_of(quality_rules.keep_good(none)) == []


def test_cascade_puts_the_best_rate_first(docs):
    def slow(t):
        return sum(range(20_000)) < 0

    ordered = quality_rules.cascade_order(docs, [quality_rules.QualityRule("slow", slow), *quality_rules.BASE, *quality_rules.EXTRA])
    assert ordered[-1].name != "few_words" and ordered.index(next(r for r in ordered if r.name == "slow")) > 0


# --- 8: quality classifier ----------------------------------------------------------------


def test_classifier(spark, odd, none):
    good = [(k, f"Line {k} says that the {'quiet ' * (k % 5)}river runs past house number {k} and on to the sea. " * 3, 1) for k in range(120)]
    bad = [(200 + k, f"BUY!!! {'NOW$$$ ' * (k % 7 + 20)} ###{k}", 0) for k in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(quality_classifier.score_quality(docs, labels, fold(F.col("doc_id"), 4, 2)))}
    held = [r for r in got.values() if r["held_out"]]
    truth = {i: q for i, _, q in good + bad}
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    assert {r["doc_id"] for r in rows_of(quality_classifier.keep_predicted(docs, labels, F.lit(False)))} >= set(range(120))
    assert len(rows_of(quality_classifier.score_quality(odd, labels, F.lit(False)))) == len(ODD)
    assert {r["score"] for r in rows_of(quality_classifier.score_quality(odd, labels.limit(0), F.lit(False)))} == {0.5}
    assert rows_of(quality_classifier.score_quality(none, labels, F.lit(False))) == []


def test_compiled_rules_equal_rules_in_python(spark, docs, odd):
    """The ensemble's column against its rules applied one by one to the statistics of each text."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    measured = quality_classifier.staged(quality_classifier.text_statistics(texts), "statistics")
    model = quality_classifier.learn_quality(measured, labels, fold(F.col("doc_id"), 4, 2))
    assert len(model.rules) > 3

    def score(text):
        t = Text(text)
        s = {name: float(f(t)) for name, f in quality_classifier.STATISTICS.items()}
        fired = [w for w, rule in model.rules if all(s[x.statistic] > x.threshold if x.above else s[x.statistic] <= x.threshold for x in rule)]
        return 1 / (1 + math.exp(-(model.intercept + sum(fired))))

    want = sorted(round(score(r.text), 9) for r in texts.collect())
    assert np.allclose(sorted(r.score for r in measured.select(model.score().alias("score")).collect()), want, atol=1e-8)


# --- 9: language-model scores -------------------------------------------------------------


class BrutePPM:
    """PPM, method C with exclusion, one symbol at a time over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, collections.defaultdict(collections.Counter)
        for t in texts:
            data = lm_scoring.START * order + t.lower() + lm_scoring.END
            for at in range(order, len(data)):
                for k in range(order + 1):
                    self.counts[data[at - k : at]][data[at]] += 1

    def score(self, text):
        data, total = lm_scoring.START * self.order + text.lower() + lm_scoring.END, 0.0
        for at in range(self.order, len(data)):
            excluded: set = set()
            for k in range(self.order, -1, -1):
                seen = self.counts.get(data[at - k : at])
                if not seen:
                    continue
                left = {s: n for s, n in seen.items() if s not in excluded}
                whole = sum(left.values()) + len(left)
                if data[at] in left:
                    total += math.log10(left[data[at]] / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                excluded |= set(seen)
            else:
                total -= math.log10(256 - len(excluded))
        return total


def test_scores_equal_brute_force(odd, none, docs):
    for frame, held in ((docs, fold(F.col("doc_id"), 7, 2)), (odd, fold(F.col("doc_id"), 7, 2)), (odd, F.lit(True))):
        rows = [(r.doc_id, (r.text or "").encode(), r.held) for r in frame.select("doc_id", "text", held.alias("held")).collect()]
        seen, ends = collections.Counter(), 0
        for _, t, h in rows:
            if not h:
                seen.update(t.lower().split())
                ends += 1
        n, v = sum(seen.values()) + ends, len(seen) + (ends > 0)
        ppm = BrutePPM([t for _, t, h in rows if not h], lm_scoring.ORDER)
        got = sorted(rows_of(lm_scoring.score_documents(frame, held, frequent=50)), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
        assert len(got) == len(rows)
        for r, (i, t, h) in zip(got, sorted(rows, key=lambda x: (str(x[0]), len(x[1].split()) + 1))):
            words = t.lower().split()
            base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
            assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (i, h, len(words) + 1, n)
            assert r["n_known"] == sum(seen[w] > 0 for w in words) + (ends > 0)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
            if len(t) < 3000:
                assert math.isclose(r["score"], ppm.score(t), rel_tol=1e-9)
    assert rows_of(lm_scoring.score_documents(none, F.lit(False))) == []


@pytest.mark.parametrize("nodes", [1, 400])
def test_scores_are_exact_beyond_the_broadcast_windows(odd, docs, nodes):
    """With room for few windows only, rare windows, contexts and bytes still count."""
    for frame in (docs, odd):
        held = fold(F.col("doc_id"), 7, 2)
        rows = [(r.doc_id, (r.text or "").encode(), r.held) for r in frame.select("doc_id", "text", held.alias("held")).collect()]
        ppm = BrutePPM([t for _, t, h in rows if not h], lm_scoring.ORDER)
        want = sorted((str(i), h, len(t.split()) + 1, ppm.score(t)) for i, t, h in rows if len(t) < 3000)
        got = rows_of(lm_scoring.score_documents(frame, held, frequent=50, nodes=nodes))
        assert len(got) == len(rows)
        long = collections.Counter((str(i), len(t.split()) + 1) for i, t, _ in rows if len(t) >= 3000)
        got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["score"]) for r in got if not long[str(r["doc_id"]), r["n_tokens"]])
        want = [w for w in want if not long[w[0], w[2]]]
        assert [w[:3] for w in want] == [g[:3] for g in got]
        assert all(math.isclose(g[3], w[3], rel_tol=1e-9) for g, w in zip(got, want))


def test_costs_of_all_symbols_sum_to_one(docs):
    trie = lm_scoring.trie_of(lm_scoring.order_counts(docs))
    for context in (b"the ", b"zzzz", lm_scoring.START * 4, b" de "):
        keys = np.array([(int.from_bytes(context, "big") << 8) | s for s in range(256)], np.uint64)
        assert math.isclose((10 ** trie.costs(keys)).sum(), 1, rel_tol=1e-9)


def test_what_is_broadcast_stays_within_its_bound(spark):
    """However many windows share a count, no more than ``nodes`` reach the least one."""
    cases = [[70_000] * 5_000, [70_000] * 5_000 + [10**9] * 3, list(range(1, 3_000)), [1] * 20, []]
    for n in cases:
        counts = spark.createDataFrame([(k, x) for k, x in enumerate(n)], "window long, n long")
        for nodes in (1, 10, 700, 10_000):
            least = lm_scoring.least_count(counts, nodes)
            assert sum(x >= least for x in n) <= nodes and (least == 1) == (len(n) <= nodes)
    assert lm_scoring.least_count(spark.createDataFrame([(k, x) for k, x in enumerate(cases[1])], "window long, n long"), 10) == 10**9


# --- 10: URL rules and trust --------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        ("http://a.com/x", "com/", "allow"), ("HTTPS://WWW.Example.COM/en/1?x#y", "www.example.com/en/", "allow"), ("http://b.example.com/en/", "example.com/en/", "block"),
        ("http://example.net/es/", "net/es/", "block"), ("http://notnet/es/", None, "allow"), ("http://com", None, "allow"), (None, None, "allow"), ("nothing", None, "allow"), ("", None, "allow"), ("x://?q", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u, None, "clash") for k, (u, _, _) in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in rows_of(url_trust.judge_urls(pages, URL_RULES))}
    assert [(got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == [(r, v) for _, r, v in urls]
    assert (got[1]["host"], got[1]["path"]) == ("www.example.com", "/en/1") and got[6]["host"] == got[6]["path"] == ""
    assert rows_of(url_trust.judge_urls(pages.limit(0), URL_RULES)) == []


def test_distrust_flows_to_those_who_link(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="//{h}/p">t</a>' for h in hosts)
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", link("bad.net")), (3, "http://farm.org/2", link("bad.net", "bad.net")), (4, "http://mixed.org/1", link("bad.net", "fine.com")), (5, "http://fine.com/1", link("friend.org")), (6, "http://friend.org/1", "<a href='/local'>x</a>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in rows_of(url_trust.judge_urls(frame, URL_RULES))}
    hosts = ["bad.net", "farm.org", "mixed.org", "fine.com", "friend.org"]
    a = np.zeros((5, 5))
    a[1, 0], a[2, 0], a[2, 3], a[3, 4] = 3, 1, 1, 1

    def rank(m, seed):
        p = m / np.maximum(m.sum(1, keepdims=True), 1)
        x = 0.15 * seed
        for _ in range(12):
            x = 0.15 * seed + 0.85 * p.T @ x
        return x

    trust, distrust = rank(a, np.array([0, 0, 0, 1.0, 0])), rank(a.T, np.array([1.0, 0, 0, 0, 0]))
    for r in got.values():
        k = hosts.index(r["host"])
        assert math.isclose(r["trust"], trust[k], abs_tol=1e-12) and math.isclose(r["distrust"], distrust[k], abs_tol=1e-12)
    assert [got[k]["verdict"] for k in (1, 2, 4, 5, 6)] == ["block", "block", "allow", "allow", "allow"]


def test_trust_reaches_distant_hosts(spark):
    """Links in a ring and a long chain: ranks are those of the linear system, not of some steps."""
    link = lambda h: f'<a href="//{h}/p">t</a>'
    ring = [(1, "http://good.com/1", link("a.org")), (2, "http://a.org/1", link("good.com"))]
    chain = [(10 + k, f"http://{'start.com' if k == 0 else f'h{k}.org'}/1", link(f"h{k + 1}.org")) for k in range(15)] + [(25, "http://h15.org/1", "")]
    frame = spark.createDataFrame(ring + chain, "page_id long, url string, html string")
    got = {r["page_id"]: r["trust"] for r in rows_of(url_trust.judge_urls(frame, URL_RULES))}
    assert math.isclose(got[1], 0.15 / (1 - 0.85**2), abs_tol=1e-6) and math.isclose(got[2], 0.85 * got[1], abs_tol=1e-6)
    assert all(math.isclose(got[10 + k], 0.15 * 0.85**k, abs_tol=1e-6) for k in range(16))


def test_new_words_are_encoded_together_and_told_apart():
    from tokenizers import Tokenizer

    from tapeloom.llm.packing import WordIds
    from tapeloom.llm.queries import tokenizer as path_of

    plain = Tokenizer.from_file(path_of("word_bpe_49k.json"))

    class Counting:
        calls = 0

        def __getattr__(self, name):
            Counting.calls += name.startswith("encode")
            return getattr(plain, name)

    texts = [" ".join(f"w{k}x, don't\u00a0{k} \u00a0 \u00c9t\u00e9{k}" for k in range(at, at + 900)) for at in (0, 900, 1800, 0)] + ["", "\u00a0"]
    words = WordIds(Counting())
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode([t.encode() for t in texts]) == want and Counting.calls == 1


def test_words_are_told_apart_with_and_without_the_mark(monkeypatch):
    """Words that hold the mark, or are empty or broken, keep their ids; kept words stay within the cache and are not encoded anew."""
    from tokenizers import Tokenizer

    from tapeloom.llm.packing import MARK, WordIds
    from tapeloom.llm.queries import tokenizer as path_of

    plain = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    texts = [f" a{MARK}b  {MARK} {MARK * 3}c ", "", " \n ", f"x{MARK}", "\u0301 a\u0301 I\u0307 \u1e9e <|endoftext|>{MARK}", "d " * 250 + f"{MARK}d", "\u4e2d\u6587 caf\u00e9 caf\u00e9."]
    texts += [" ".join(f"k{n}" for n in range(5_000))]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "CACHE_BYTES", 50_000)
    words = WordIds(plain)
    for part in (slice(None, 4), slice(4, None), slice(None)):
        assert words.encode([t.encode() for t in texts[part]]) == want[part]
        assert 0 < words.known.get_total_buffer_size() + words.ids.nbytes + words.ends.nbytes <= 50_000 + 64
    assert words.encode([b"\xff x", b"x"]) == [np.array(plain.encode("\ufffd x", add_special_tokens=False).ids, "<u4").tobytes(), words.encode([b"x"])[0]]
    table = np.random.default_rng(5).integers(0, 90, 2_000)
    again = [" ".join(f"k{n}" for n in table)]
    monkeypatch.setattr(WordIds, "_encode_new", lambda self, new: (np.zeros(0, "<u4"), np.zeros(0, np.int64)) if not len(new) else pytest.fail("a kept word was encoded anew"))
    assert len(words.encode([t.encode() for t in again])) == 1


def test_a_worker_keeps_one_operators_cache():
    """A Python worker that packed and then joins holds no tokenizer and no words of the packing."""
    import gc
    import weakref

    from tapeloom.llm.queries import tokenizer as path_of

    class Shared:
        value = token_counts.vocabulary_bytes(path_of("word_bpe_49k.json"))

    words = packing._word_ids(Shared)
    assert packing._word_ids(Shared) is words
    gone = weakref.ref(words)
    del words
    jaccard_join.shingles(b"one two three four five", 4)
    gc.collect()
    assert gone() is None
