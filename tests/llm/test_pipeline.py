"""The pipeline's stages, each against its operator's decisions on the stage's own input."""

from collections import Counter

import corpus_pipeline as P
from netweft.llm import classifier, jaccard, mixing, packing, rules
from netweft.llm.queries import vocabulary


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "mix_sources", "pack_sequences"]
    outs = [docs]
    for _, stage in P.STAGES:
        outs.append(P.cut(stage(spark, outs[-1], sf), "test-stage"))
    rows = [Counter(map(tuple, d.select(*P.COLUMNS).collect())) for d in outs[:5]]
    ids = [Counter(r[0] for r in x.elements()) for x in rows]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert set(ids[1]) == {r["doc_id"] for r in classifier.classify(docs, labels).where("predicted = 1").collect()}
    assert set(ids[2]) == {r["doc_id"] for r in rules.judge(outs[1]).where("kept").collect()}
    assert set(ids[3]) == {r["component_id"] for r in jaccard.join(outs[2]).collect()}
    assert ids[4] == Counter({r["doc_id"]: r["repeats"] for r in mixing.mix(outs[3]).collect() if r["repeats"]})
    for a, b in zip(rows[:3], rows[1:4]):
        assert not b - a
    want = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pieces(outs[4], vocabulary()).collect())
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in outs[5].collect()) == want
    base_failed = {r["doc_id"] for r in rules.judge(docs).where("base_failed").collect()}
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()} - base_failed
    assert len(clean & set(ids[2])) >= 0.95 * len(clean)


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS)
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, sf), "test-run")
    pieces = lambda d: Counter(map(tuple, d.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    ran = pieces(P.run(spark, sf))
    assert ran == pieces(docs) and ran.total() > 100
