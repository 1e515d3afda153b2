import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_keeps_columns_and_packs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("toxicity", "near_duplicates"):
            assert 0 < docs.count() <= n
            n = docs.count()
    held = {}
    for r in docs.collect():
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 1024
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    mixed = [r["text"] or "" for r in spark.read.parquet(str(tmp_path / "mixing")).select("text").collect()]
    assert sum(n for pieces in held.values() for _, n in pieces) == sum(len(x.ids) + 1 for x in library.encode_batch(mixed, add_special_tokens=False))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
