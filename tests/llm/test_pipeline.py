"""The pipeline's stages on a small table, each against what its operator decides."""

import corpus_pipeline
from pyspark.sql import functions as F

from loanlab.llm.common import stored, table

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "byte_bpe"]
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "src0", 0)],
                                table(spark, SF, "documents").schema)
    docs = table(spark, SF, "documents").union(odd).withColumn("__extra", F.lit(1))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), "test-stage"))
    assert all(f.columns == docs.columns for f in seen[:-1])
    raw, clean, unique, redacted, mixed, ids = seen
    toxic = table(spark, SF, "labels").where("toxic = 1").select("doc_id")
    n_toxic = raw.join(toxic, "doc_id", "left_semi").count()
    assert clean.join(toxic, "doc_id", "left_semi").count() <= 0.2 * n_toxic
    from loanlab.llm import minhash, secretscan
    assert minhash.near_duplicates(unique).where("not kept").count() == 0
    assert redacted.count() == unique.count() and secretscan.scan(redacted).where("spans <> ''").count() == 0
    assert ids.count() == mixed.count()
    assert mixed.select("doc_id").distinct().join(redacted, "doc_id", "left_anti").count() == 0


def test_run_is_the_chain(spark, sf001):
    out = corpus_pipeline.run(spark, sf001)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0
