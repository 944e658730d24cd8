"""The stages of the pipeline, each against its operator's own result on its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import mixing, quality, simhash, toxicity
from quadrille.llm.common import materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF), "stage"))
    return out


def test_shapes(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and corpus_pipeline.ORACLE_SQL is None
    n = [s.count() for s in stages]
    assert n[0] > n[1] > n[2] > n[3] > 0 and n[5] > 0


def test_filters_keep_what_their_operators_keep(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(stages[1]) == ids(toxicity.score_documents(stages[0], labels).where("predicted = 0"))
    assert ids(stages[2]) == ids(quality.score_documents(stages[1], labels).where("kept"))
    assert ids(stages[3]) == ids(simhash.near_duplicates(stages[2], simhash.NEAR_COPIES).where("doc_id = component_id"))
    good = stages[0].join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    assert stages[2].join(good.select("doc_id"), "doc_id", "left_semi").count() >= 0.98 * good.count()


def test_no_copies_are_left(stages):
    texts = [r["text"] for r in stages[3].select("text").collect()]
    assert len(set(texts)) == len(texts)
    shingles = []
    for t in texts:
        w = (t or "").encode().lower().split()
        shingles.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    held: dict[bytes, list[int]] = {}
    for i, s in enumerate(shingles):
        for g in sorted(s)[:10]:
            held.setdefault(g, []).append(i)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    near = [p for p in pairs if len(shingles[p[0]] & shingles[p[1]]) >= 0.85 * len(shingles[p[0]] | shingles[p[1]])]
    assert len(near) <= 2


def test_mix_and_packing(stages):
    taken = mixing.mix(stages[3]).agg(F.sum("taken")).first()[0]
    words = stages[4].select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == taken
    p = stages[5].toPandas()
    for _, s in p.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 1024
    assert p.doc_id.nunique() == stages[4].select("doc_id").distinct().count()
    assert p.sequence_id.nunique() <= p.length.sum() / 1024 * 1.02 + 2


def test_run_equals_the_stages(spark, stages):
    a, b = (sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) for df in (corpus_pipeline.run(spark, SF), stages[-1]))
    assert a == b
