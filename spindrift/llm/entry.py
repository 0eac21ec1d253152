"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, exact_dedup, merkle, near_dedup, packing, quality, reshard, sentencepiece, spelling, substring_dedup, toxicity, training_order, warc


def queries() -> dict:
    return {
        "op1_multiprobe_ann": ann.op1_multiprobe_ann,
        "op2_flow_resharding": reshard.op2_flow_resharding,
        "op3_chunk_dedup": substring_dedup.op3_chunk_dedup,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
        "op6_training_order": training_order.op6_training_order,
        "op7_compression_quality": quality.op7_compression_quality,
        "op8_ordered_packing": packing.op8_ordered_packing,
        "op9_toxicity_chain": toxicity.op9_toxicity_chain,
        "op10_sentencepiece": sentencepiece.op10_sentencepiece,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_warc_records": warc.op12_warc_records,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_warc_records": warc.OP12_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
