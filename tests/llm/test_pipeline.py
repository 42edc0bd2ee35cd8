"""The pipeline's stages, each on what the one before kept."""

import hashlib

from test_corpus_operators import documents, prose

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng_rows = [(i, prose(i, 150)) for i in range(40)]
    near = prose(3, 150).split()
    near[70] = "changed"
    rows = rng_rows + [(100, prose(1, 150)), (101, prose(1, 150).upper().replace("ALPHA", "alpha")), (102, " ".join(near)), (103, None), (104, "123 !!"), (105, prose(50, 60) + " password=hunter2hunter2 end")]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        if name != "best-fit packing":
            assert kept.columns == docs.columns
            seen[name] = {r.doc_id: r.text for r in kept.collect()}
    assert set(seen["language ID"]) == {i for i, _ in rows} - {103, 104}
    assert set(seen["exact dedup"]) == set(seen["language ID"]) - {1, 100}
    assert set(seen["MinHash near-dedup"]) == set(seen["exact dedup"]) - {102}
    assert set(seen["secret scans"]) == set(seen["MinHash near-dedup"])
    assert "[SECRET]" in seen["secret scans"][105] and "hunter2" not in seen["secret scans"][105]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["secret scans"])
    assert hashlib.sha256(repr(sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)).encode()).hexdigest() == hashlib.sha256(repr(sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept.collect())).encode()).hexdigest()
