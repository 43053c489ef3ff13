"""The corpus pipeline, stage by stage."""

import random

import pytest

import corpus_pipeline
from test_operators import DOC, groups, odd, sentence  # noqa: F401

ITEM = "the ninth answer is hidden under the old bridge where nobody ever looks twice in winter"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    passage = sentence(rng, 60)
    docs, labels = [], []
    for i in range(240):
        t = sentence(rng, 60) + (" vile wretch vilest vile" if i % 6 == 0 else "")
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    extra = [(500, docs[1][1]), (501, docs[2][1] + " end"), (502, sentence(rng, 20) + " " + passage), (503, sentence(rng, 25) + " " + passage), (504, sentence(rng, 30) + " " + ITEM), (505, None), (506, ""), (None, sentence(rng, 30))]
    extra += [(502, extra[2][1]), (503, extra[3][1]), (None, extra[-1][1])]  # repeated rows that share a passage
    docs += [(i, t, "en", "s", None if t is None else len(t)) for i, t in extra] + [docs[3]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, path), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = out.collect()
        docs = out
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    clean = {i for i in range(240) if i % 6} | {500, 501, 502, 503, 504, 505, 506, None}
    assert ids["toxicity"] == clean
    assert ids["near_dedup"] == clean - {500, 501} and len(seen["near_dedup"]) == len(ids["near_dedup"])
    assert {(d, c) for (d, _, c) in groups([(r.doc_id, r.text) for r in seen["near_dedup"]])} == {(i, i) for i in ids["near_dedup"]}
    texts = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert passage in texts[502] and passage not in texts[503] and set(texts) == ids["near_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {504}
    assert all(r.round_trip and len(r.piece_ids) == r.n_pieces for r in seen["sentence_pieces"])
    assert corpus_pipeline.run(spark, path).count() == len(seen["sentence_pieces"])


def test_odd_tables(spark, folder):
    """Each stage takes an empty table, and columns that have the operators' own names."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
        wide = odd(spark, docs.limit(30))
        out = stage(spark, wide, path)
        assert set(wide.columns) <= set(out.columns)
        got = {r.doc_id: r for r in out.collect()}
        want = {r.doc_id: r for r in wide.collect() if name != "toxicity" or r.doc_id % 6}
        assert set(got) == set(want)
        others = [c for c in wide.columns if c != "text"]
        assert all([got[i][c] for c in others] == [want[i][c] for c in others] for i in got)
