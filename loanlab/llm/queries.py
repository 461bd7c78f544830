"""Registered queries of this subpackage: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from . import bpe
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN, keep_ids=False)


def op2_language_id(spark, sf_dir):
    from . import langid
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_host_quality(spark, sf_dir):
    from . import hostrules
    return hostrules.apply_rules(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark, sf_dir):
    from . import minhash
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    from . import toxicity
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_pivot_top_k(spark, sf_dir):
    from . import pivots
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_mix_sources(spark, sf_dir):
    from . import mixing
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_chat_prefix_target(spark, sf_dir):
    from . import chat
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_examples(turns.unionByName(extra)))


def op9_secret_scan(spark, sf_dir):
    from . import secretscan
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op10_pack_token_ids(spark, sf_dir):
    import public_tokenizers

    from . import packing
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN)


def op11_benchmark_decontamination(spark, sf_dir):
    from . import decontam
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark, sf_dir):
    from . import whiten
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark, sf_dir):
    from . import lexical
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracles():
    from . import chat, decontam, hostrules, lexical, pivots
    return {"op11_benchmark_decontamination": decontam.ORACLE, "op13_lexical_search": lexical.ORACLE,
            "op6_pivot_top_k": pivots.ORACLE, "op3_host_quality": hostrules.ORACLE, "op8_chat_prefix_target": chat.ORACLE}


def all_queries() -> dict:
    oracles = _oracles()
    names = [n for n in globals() if n.startswith("op")]
    out = {n: (globals()[n], oracles.get(n)) for n in names}
    import corpus_pipeline
    out["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
    return out
