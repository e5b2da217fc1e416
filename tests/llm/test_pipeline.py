"""The pipeline's stages: each decision takes effect, clean documents stay, columns last."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402
from sparkwarden.llm import packing, simhash  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "simhash", "packing"]


def test_filters(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages[:3]]
    assert ids[2] < ids[1] < ids[0]
    # some forty toxic and fifty junk examples in four languages teach only part of what there is
    for before, after, label, bad, least in ((ids[0], ids[1], "toxic", 1, 0.6), (ids[1], ids[2], "quality", 0, 0.85)):
        clean = [d for d in before if d in labels and labels[d][label] != bad]
        junk = [d for d in before if d in labels and labels[d][label] == bad]
        assert sum(d in after for d in clean) >= 0.99 * len(clean)
        assert sum(d not in after for d in junk) >= least * len(junk)


def test_columns_last(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_lines_appear_once(stages):
    seen = [" ".join(x.lower().split()) for r in stages[3].collect() for x in r.text.split("\n") if x.strip()]
    assert len(seen) == len(set(seen))
    assert stages[3].count() == stages[2].count()
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_one_document_of_each_group(stages):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(stages[3]).collect()}
    assert {r.doc_id for r in stages[4].collect()} == {d for d, c in found.items() if d == c}


def test_packed(stages):
    rows, docs = stages[5].collect(), stages[4].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs}
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert all(s & (s - 1) == 0 and s <= packing.WINDOWS[-1] for s in size.values())


def test_run_equals_the_stages(spark, stages):
    key = ("doc_id", "start", "length", "doc_tokens")
    got = sorted(tuple(r[k] for k in key[:1]) for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect())
    assert got == sorted((r.doc_id,) for r in stages[4].select("doc_id").collect())


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = [(None, None, None, None, None, 1.0, "r"), (-5, "", "en", "s", 0, 2.0, "r"), (-6, "clean words " * 5, None, None, None, None, None)]
    docs = docs.selectExpr("*", "nullif(0.5D, doc_id) AS score", "nullif('x', lang) AS removed")
    docs = docs.unionByName(spark.createDataFrame([*odd, odd[2]], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert -6 in {r.doc_id for r in rows}
