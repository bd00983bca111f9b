"""Every stage against a plain reading of what it decides."""

from collections import Counter

import corpus_pipeline
from duelframe.llm import sentencepiece_codec
from duelframe.llm.common import settle
from duelframe.session import materialize

from ..conftest import SF
from .test_dedup import expected_near


def test_stages(spark):
    docs = settle(spark).read.parquet(f"{SF}/documents.parquet")
    more = [(1000, "12 34 ?!", None, "junk", 8), (1001, None, "en", None, 0), (1002, "", "en", "src1", 0), (None, "the of and to in is was that", "en", "src1", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    seen = [materialize(docs, "test-docs")]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), f"test-{name}"))
        if name != "sentencepiece":
            assert seen[-1].columns == docs.columns
    start, known, exact, near, mixed = ([tuple(r) for r in d.collect()] for d in seen[:5])
    assert Counter(r for r in start if r[0] not in (1000, 1001, 1002)) == Counter(known)
    best = {}
    for r in known:
        best[r[1]] = max(best.get(r[1], -1), -1 if r[0] is None else r[0])
    assert sorted(-1 if r[0] is None else r[0] for r in exact) == sorted(best.values())
    keep = {i for i, _, _, kept in expected_near([(r[0], r[1]) for r in exact if r[0] is not None], size=5) if kept}
    assert {r[0] for r in near} == keep | {None}
    counts = Counter(mixed)
    assert set(counts) <= set(near) and max(counts.values()) <= 3 and len(mixed) > 50
    words = sum(len(r[1].split()) for r in near)
    assert abs(sum(len(r[1].split()) for r in mixed) / words - 1) < 0.4
    pieces = sentencepiece_codec.load()
    coded = Counter((r.doc_id, sentencepiece_codec.decode(pieces, r.ids)) for r in seen[5].collect())
    assert coded == Counter((r[0], r[1].replace("▁", " ")) for r in mixed)
