"""Each stage of the pipeline against a brute-force version on that stage's own input."""

import hashlib

import corpus_pipeline as pipeline
from marktrace.llm.common import stored
from marktrace.llm.quality import quality_scores
from test_contamination import brute as brute_contamination
from test_lines_quality import brute_lines
from test_near_duplicates import brute as brute_near
from test_tokens_packing import WORDS

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = table("documents").union(spark.createDataFrame([(None, "no id at all here", "en", "s", 17), (None, None, None, None, None), (7, "one text more", "en", "s", 13), (7, "one text more", "en", "s", 13)], table("documents").schema)).repartition(5)
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    docs = stored(docs, "test-documents")
    seen = []
    for name, stage in pipeline.STAGES:
        before, out = rows(docs), stored(stage(spark, docs, SF), "test-stage")
        seen.append(name)
        if name != "best-fit packing":
            assert out.columns == pipeline.COLUMNS
            after = sorted(rows(out), key=str)
        if name == "quality classifier":
            scored = quality_scores(docs, table("labels")).where("score >= 0.3")
            assert after == sorted(rows(scored), key=str) and len(before) * 0.7 < len(after) < len(before)
        elif name == "line dedup":
            want = [(i, h) for i, _, _, h in brute_lines(before)]
            assert sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in after), key=str) == sorted(want, key=str)
        elif name == "minhash near-dedup":
            classes = {c[:2] if c[1] is not None else c for c in brute_near(before)}
            assert {i for i, _ in after if i is not None} == {c[1] for c in classes if c[1] is not None}
            assert set(after) <= set(before) and len(after) == len(set(after))
        elif name == "benchmark decontamination":
            dirty = {w[0] for w in brute_contamination(before, items) if w[-1]}
            assert dirty and after == sorted((r for r in before if r[0] not in dirty), key=str)
        else:
            want = sum(len(WORDS.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in before)
            assert sum(r.length for r in out.collect()) == want
            assert out.select("sequence_id").distinct().count() <= -(-want // 2048) + 2
        docs = out
    assert seen == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_run(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
