"""The pipeline's stages, each on what the one before it has left."""

import re
from collections import Counter

import pytest
from brute import SF, components_of
from test_llm_brute import check_packing, fingerprint

import corpus_pipeline as pipeline
from gridlore.llm import mixing, quality
from gridlore.session import materialise


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "test"))
    return out


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.scored(stages[0], quality.fit(stages[0], labels))
    assert sorted(pairs(stages[1])) == sorted(pairs(stages[0].join(scores.filter("predicted = 1").select("doc_id"), "doc_id")))
    kept = {i for i, _ in pairs(stages[1])}
    good = [r.doc_id for r in labels.collect() if r.quality == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_dedup_stages(stages):
    seen, want = set(), []
    for i, t in sorted(pairs(stages[1])):
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if n not in seen:
            seen.add(n)
            want.append((i, t))
    assert sorted(pairs(stages[2])) == want
    prints = [fingerprint(t) for _, t in want]
    links = [(a, b) for b in range(len(want)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert sorted(pairs(stages[3])) == [want[m[0]] for m in sorted(components_of(len(want), links).values())]


def test_mix_and_packing_stages(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert Counter(i for i, _ in pairs(stages[4])) == +Counter(copies)
    n, tokens = check_packing([t for _, t in pairs(stages[4])], stages[5].collect())
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_run(spark, stages):
    rows = pipeline.run(spark, SF).drop("sequence_id", "offset")
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, stages[5].select(rows.columns).collect()))


def test_odd_rows_pass_all_stages(spark, odd, empty):
    for docs in (odd, empty):
        df = docs
        for _, stage in pipeline.STAGES[1:]:
            df = stage(spark, df, SF)
        assert (df.count() > 0) == (docs.count() > 0)
    assert pipeline.good_quality(spark, odd, SF).columns == odd.columns
    assert pipeline.good_quality(spark, empty, SF).collect() == []
