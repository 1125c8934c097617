"""The pipeline's stages on documents with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from palisade.llm import common

from ..conftest import SF
from .test_operators import check_packing, near_copies, words


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = common.table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        n = docs.count()
        assert (n == before) if name == "line_dedup" else n <= before
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
            assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * (len(labels) - sum(labels.values()))
        before = n
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    used, padding = check_packing(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    assert padding <= 0.001 * used
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r) for r in whole) == sorted(tuple(r) for r in pieces)


def test_planted(spark):
    rng = random.Random(9)
    item = next(r.text for r in common.table(spark, SF, "benchmark").collect() if len(r.text.split()) > 20)
    clean = [(i, words(rng, 150)) for i in range(30)]
    copies = [(100 + i, t) for i, t in enumerate([clean[0][1], *near_copies(rng, clean[1][1], 4, 1)])]
    dirty = [(200, words(rng, 40) + " " + item + " " + words(rng, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean + copies + dirty], common.table(spark, SF, "documents").schema)
    once = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in once.collect()} == {i for i, _ in clean + dirty}
    left = corpus_pipeline.decontamination(spark, once, SF)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in clean}
    assert corpus_pipeline.line_dedup(spark, docs, SF).count() == docs.count()


def test_awkward_stages(spark):
    """Clashing columns, null ids, repeated rows and empty tables keep the columns and what isn't rejected."""
    from .test_operators import awkward

    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.filter("row__ != 'clash'").isEmpty()
        ids = {r.doc_id for r in out.collect()}
        if name in ("line_dedup", "packing"):
            assert ids == {r.doc_id for r in docs.collect()}
        if name in ("near_duplicates", "decontamination"):
            assert {None, 3, 4, 7} <= ids
        assert stage(spark, docs.limit(0), SF).count() == 0
