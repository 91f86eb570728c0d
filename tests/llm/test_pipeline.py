"""The pipeline, stage by stage, against the operators' brute-force versions."""

import corpus_pipeline
from test_operators import brute_base, brute_groups, brute_redacted, brute_removed, check_packing


def test_stages(spark, docs, texts, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in texts if i is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, names = docs, docs.columns
    left = list(texts)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            left = [(i, t) for i, t in left if not brute_base(t)[-1]]
        elif name == "near_dedup":
            kept = {r[0] for r in brute_groups(left, 5) if r[3]}
            left = [(i, t) for i, t in left if i in kept]
        elif name == "substring_dedup":
            left = [(i, t if not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode()) for (i, t), (w, gone) in zip(left, brute_removed(left), strict=True)]
        elif name == "secret_scans":
            left = [(i, brute_redacted(t)) for i, t in left]
        if name == "packing":
            check_packing(now.collect(), left)
        else:
            assert now.columns == names
            assert sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr) == sorted(left, key=repr)
    assert left


def test_run_over_small_tables(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r["length"] <= 4096 for r in got)
