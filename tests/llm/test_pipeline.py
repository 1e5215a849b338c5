import corpus_pipeline
from aularank.llm import op7_quality, op8_decontaminate, op9_simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    one = corpus_pipeline.near_dedup(spark, kept, SF)
    fps = sorted((op9_simhash.fingerprint(t.encode()), i) for i, t in texts.items())
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for k, (f, i) in enumerate(fps):
        for g, j in fps[:k]:
            if (f ^ g).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    stay = {find(i) for i in texts}
    assert {r["doc_id"] for r in one.collect()} == stay and one.columns == docs.columns
    items = [set(op8_decontaminate.shingles(r["text"].encode(), 5)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in stay if not any(len(s & set(op8_decontaminate.shingles(texts[i].encode(), 5))) * 5 >= len(s) * 4 for s in items if s)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == clean and clean < stay
    used = {}
    for r in out:
        used[r["bin"]] = used.get(r["bin"], 0) + r["length"]
    assert max(used.values()) <= 2048
    bad = {i for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if op7_quality.counts(t.encode(), t.encode().split())[0] < 50}
    assert not bad & set(texts)
