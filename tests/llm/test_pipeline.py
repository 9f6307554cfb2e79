import re
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from llm.test_mix_pack import brute_targets, check_sequences
from llm.test_similar import brute, components, shingles
from llm.util import data, odd_documents, there
from tidestep.llm.common import BATCH, BATCH_BYTES, tidy
from tidestep.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not there("sf0.001"), reason="no test tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{data('sf0.001')}/documents.parquet")
    got = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data("sf0.001")).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        got.append((name, before.collect(), docs.collect()))
        if name != "packing":
            assert docs.columns == COLUMNS
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {name: (a, b) for name, a, b in got}
    a, b = by["toxicity"]
    assert {r.doc_id for r in b} <= {r.doc_id for r in a} and len(b) > 0.8 * len(a)
    a, b = by["exact_dedup"]
    least = {}
    for r in sorted(a, key=lambda r: r.doc_id):
        least.setdefault(norm(r.text), r.doc_id)
    assert sorted(r.doc_id for r in b) == sorted(least.values())
    a, b = by["simhash_dedup"]
    least = {}
    for r in a:
        least[shingles(r.text)] = min(r.doc_id, least.get(shingles(r.text), r.doc_id))
    groups = components(list(least), brute(list(least)))
    assert sorted(r.doc_id for r in b) == sorted(min(least[s] for s in g) for g in groups)
    a, b = by["mixing"]
    sizes, out, text = defaultdict(int), defaultdict(int), {r.doc_id: r.text for r in a}
    for r in a:
        sizes[r.source] += len(r.text.split())
    for r in b:
        out[r.source] += len(r.text.split())
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    for s, t in brute_targets(sizes).items():
        assert out[s] == int(t + 1e-9)
    a, b = by["packing"]
    import numpy as np

    check_sequences(*(np.array([getattr(r, c) for r in b]) for c in ("sequence_id", "offset", "length")))
    assert len({r.doc_id for r in b}) == len({r.doc_id for r in a})


def test_stages_stand_odd_rows(spark, tmp_path):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars", "kept", "Score")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for empty in (docs, docs.limit(0)):
        rows = empty
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            if name != "packing":
                assert rows.columns == docs.columns
        assert (rows.count() > 0) == (empty is docs)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_send_texts_to_python_in_small_batches(spark, tmp_path, name, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "rows"])

    docs = odd_documents(spark).selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars").limit(0)
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 1000) as text")
    spark.conf.unset(BATCH_BYTES)
    try:
        stage(spark, docs, str(tmp_path))
        got = long.mapInArrow(sizes, "size bigint, rows bigint").collect()
        assert sum(r.rows for r in got) == 3000 and max(r.size for r in got) <= 1.1 * BATCH
        spark.conf.set(BATCH_BYTES, "1m")
        tidy(spark)
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)
