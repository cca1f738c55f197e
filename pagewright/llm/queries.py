"""Queries of the thirteen operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from . import annjoin, codec, compaction, divergence, htmlmain, langid, media, mixing, neardup, setjoin, sharding, tokcount, toxicity
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokcount.count_tokens(table(spark, sf_dir, "documents"), tokenizer(tokcount.MODEL))


def op3_pfair_mix(spark, sf_dir):
    return mixing.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_html_main_text(spark, sf_dir):
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark, sf_dir):
    return codec.round_trip(table(spark, sf_dir, "documents"), tokenizer(codec.FILE))


def op6_jump_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_lsh_forest(spark, sf_dir):
    return neardup.components(spark, table(spark, sf_dir, "documents"))


def op8_block_matrix_join(spark, sf_dir):
    return annjoin.nearest(table(spark, sf_dir, "embeddings"))


def op9_lossless_webp(spark, sf_dir):
    return media.media(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.detect(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sqrt_compaction(spark, sf_dir):
    return compaction.compact(spark, table(spark, sf_dir, "clicks"))


def op12_divergence_audit(spark, sf_dir):
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op13_segment_join(spark, sf_dir):
    return setjoin.components(spark, table(spark, sf_dir, "documents"))


_ALL = (op1_language_id, op2_token_counts, op3_pfair_mix, op4_html_main_text, op5_byte_bpe, op6_jump_shards, op7_lsh_forest, op8_block_matrix_join, op9_lossless_webp, op10_toxicity, op11_sqrt_compaction, op12_divergence_audit, op13_segment_join)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op6_jump_shards": sharding.ORACLE, "op7_lsh_forest": neardup.ORACLE, "op8_block_matrix_join": annjoin.ORACLE, "op12_divergence_audit": divergence.ORACLE, "op13_segment_join": setjoin.ORACLE}
