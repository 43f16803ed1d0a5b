import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare

import corpus_pipeline
from noticeflow.llm import bpe, jaccard, quality_model, quality_rules, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_joins import brute
from test_quality_rules import counts, plain_distances

pytestmark = pytest.mark.skipif(not compare.present, reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    compare.same_rows(queries.QUERIES[name](spark, compare.SMALL), compare.connection(compare.SMALL), queries.SQL[name])


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{compare.SMALL}/documents.parquet")
    at, before = docs, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        from noticeflow.llm.common import written

        out = written(stage(spark, at, compare.SMALL), name)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= before and ids
        if name != "encoding":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert len(ids) == len(set(ids)) == jaccard.join(out).select("component_id").distinct().count()
        if name == "encoding":
            assert sorted(ids) == sorted(r["doc_id"] for r in at.collect())
            row, text = out.first(), {r["doc_id"]: r["text"] for r in at.collect()}
            import numpy as np

            enc = bpe.Encoder(bpe.read_spec(queries.tokenizer_path()))
            assert list(np.frombuffer(enc.encode(text[row["doc_id"]]), np.int32)) == row["ids"]
        at, before = out, set(ids)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{compare.SMALL}/documents.parquet").collect()}


def test_bpe_query_against_the_library(spark, texts):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_bpe(spark, compare.SMALL).collect()}
    want = {}
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_join_query_against_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_ngram_jaccard(spark, compare.SMALL).collect()}
    assert got == brute(list(texts.items()))


def test_rules_query_against_brute_force(spark, texts):
    for r in queries.op8_quality_rules(spark, compare.SMALL).collect():
        n, chars, symbols, lines, repeats = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("folder", [compare.SMALL, "/root/testdata/sf0.01"])
def test_verdicts_of_the_rules_query_against_numpy(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = {r["doc_id"]: r["kept"] for r in queries.op8_quality_rules(spark, folder).collect()}
    want, cut = plain_distances(docs), quality_rules.CUT
    clear = {i: d <= cut for i, d in want.items() if not 0.67 * cut < d < 1.5 * cut}  # other starts move an estimate a little
    assert set(got) == set(want) and len(clear) > 0.95 * len(want) and any(clear.values()) and not all(clear.values())
    assert sum(got[i] != k for i, k in clear.items()) == 0


def test_model_query_on_held_out_labels(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op5_quality_model(spark, compare.SMALL).collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{compare.SMALL}/labels.parquet").collect() if r["quality"] is not None}
    right = [rows[i]["predicted"] == q for i, q in truth.items() if rows[i]["held_out"]]
    assert sum(right) / len(right) > 0.85


def test_stages_on_odd_rows(spark):
    """Empty table, nulls in every column, repeated rows, a very long text, clashing names."""
    docs = spark.read.parquet(f"{compare.SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, None, None), (10**6 + 1, "word " * 100_000, "en", None, None)], docs.schema)
    names = ("kept", "n_words", "score", "stats", "gone", "base_failed", "copy_no")
    mixed = docs.limit(30).unionByName(docs.limit(30)).unionByName(odd).withColumns({n: F.lit("mine") for n in names})
    for table in (docs.limit(0), mixed):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, compare.SMALL)
            if name != "encoding":
                assert out.columns == table.columns
                assert all(r[n] == "mine" for r in out.collect() for n in names if n in out.columns)
            assert table is mixed or out.count() == 0


def test_rows_that_stay_of_odd_ones(spark):
    """What each stage keeps of rows that come twice, nulls, an empty and a very long text."""
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{compare.SMALL}/documents.parquet").orderBy("doc_id").limit(30)
    empty, long, none = 10**6, 10**6 + 1, 10**6 + 2
    odd = [(None, None, None, None, None), (empty, "", None, None, None), (long, "word " * 100_000, "en", None, None), (none, None, "en", "a|b", None)]
    rows = [*map(tuple, docs.collect())] * 2 + [(i, t, lang, source, n) for i, t, lang, source, n in odd]
    mixed = spark.createDataFrame(rows, docs.schema)
    text = {r[0]: r[1] for r in rows}
    stay = {name: stage(spark, mixed, compare.SMALL).collect() for name, stage in corpus_pipeline.STAGES}
    ids = {name: Counter(r["doc_id"] for r in out) for name, out in stay.items()}
    for name in ("quality_rules", "quality_model"):  # copies are judged alike, rows come out as they were
        assert set(ids[name].values()) <= {1, 2} and all(n == 2 for i, n in ids[name].items() if i is not None and i < empty)
        assert all(tuple(r) in rows for r in stay[name])
    failed = {i for i, t in text.items() for n, _, _, _, repeats in [counts(t)] if n < 20 or 100 * repeats > 30 * n}
    assert {None, empty, long, none} <= failed and not failed & set(ids["quality_rules"]) and ids["quality_rules"]
    groups = brute([(i, t) for i, t in text.items() if i is not None])
    assert ids["near_duplicates"] == Counter({i: 2 if i < empty else 1 for i, (_, least) in groups.items() if i == least} | {None: 1})
    assert set(ids["mixing"]) <= set(text) and all(tuple(r) in rows for r in stay["mixing"])
    assert ids["encoding"] == Counter(r[0] for r in rows)
    for r in stay["encoding"]:
        want = lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == lib.decode(want, skip_special_tokens=False)


def test_model_stage_writes_no_text_beside_its_result(spark, monkeypatch):
    docs, scratch = spark.read.parquet(f"{compare.SMALL}/documents.parquet"), []
    kept = lambda df, name: scratch.append(df.columns) or quality_model.written(df, name)
    monkeypatch.setattr(corpus_pipeline, "written", kept)
    out = corpus_pipeline.quality_model_stage(spark, docs, compare.SMALL)
    assert scratch == [["doc_id", "stats"]] and out.columns == docs.columns
    scored = {r["doc_id"]: r["score"] for r in queries.QUERIES["op5_quality_model"](spark, compare.SMALL).collect()}
    assert {r["doc_id"] for r in out.collect()} == {i for i, s in scored.items() if s >= queries.THRESHOLD}
