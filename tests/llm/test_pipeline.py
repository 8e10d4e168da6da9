"""The pipeline's stages: what each keeps, against its own rule applied to its own input."""

import collections
import os

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tapeloom.llm.features import Text
from tapeloom.llm.quality_rules import BASE, EXTRA
from tests.llm.test_operators import brute_join

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.staged(stage(spark, seen[-1], FOLDER), name))
    first, ruled, liked, unique, mixed, packed = seen
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = lambda s: [r.doc_id for r in s.collect()]
    assert sorted(ids(ruled)) == sorted(r.doc_id for r in first.collect() if not any(x.rejects(Text(r.text)) for x in BASE + EXTRA))
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    assert set(ids(liked)) <= set(ids(ruled)) and len(good & set(ids(liked))) >= 0.95 * len(good & set(ids(ruled)))
    groups = brute_join([(r.doc_id, r.text) for r in liked.collect()], 5, 80)
    assert sorted(ids(unique)) == sorted({c for _, _, c, _ in groups})
    copies = collections.Counter(ids(mixed))
    assert set(copies) <= set(ids(unique)) and max(copies.values()) <= 3
    words = {r.doc_id: len(r.text.split()) for r in unique.collect()}
    assert abs(sum(words[i] * n for i, n in copies.items()) - sum(words.values())) <= max(words.values()) * 20
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in unique.collect()}
    want = sum(n * (len(whole.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())
    assert sum(r.length for r in packed.collect()) == want


def test_odd_rows_pass_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, docs.first().text, None, None, None), (None, None, None, None, 0), (1, "", "en", "x", 0), (1, docs.first().text, None, None, None)], docs.schema)
    for start in (docs.limit(0), docs.unionByName(odd)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.staged(stage(spark, rows, FOLDER), name)
        assert (rows.count() > 0) == (start.count() > 0)


def test_dedup_tells_rows_apart_by_all_columns(spark, tmp_path):
    text = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(3).collect()]
    rows = [(1, text[0], "a"), (1, text[1], "a"), (None, text[2], "a"), (None, text[2], "a"), (None, text[2], "b"), (7, text[0], "a"), (-3, text[1] + " x", "a"), (9, "", None), (None, None, None)]
    for k, r in enumerate(rows):  # a file each, so that copies meet in different tasks
        spark.createDataFrame([r], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.jaccard_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), FOLDER).collect()
    told = collections.Counter((r.doc_id, r.text) for r in got)
    assert told == collections.Counter({(1, text[0]): 1, (-3, text[1] + " x"): 1, (None, text[2]): 1, (9, ""): 1, (None, None): 1})


def test_clashing_columns_pass_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["s_words", "mixed_copies", "mixed_copy", "mixed_id", "jaccard_row", "class", "row", "d0", "S_Lines", "odd name"]
    rows = docs.select("*", *[(F.col("doc_id") % 7 + k).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.staged(stage(spark, rows, FOLDER), name)
        assert rows.columns == [*docs.columns, *names]
        assert rows.filter(" or ".join(f"`{n}` <> doc_id % 7 + {k}" for k, n in enumerate(names))).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, rows, FOLDER).count() > 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
