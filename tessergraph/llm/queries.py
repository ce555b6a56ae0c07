"""Queries of the training-data operators and, where SQL can say the same, that SQL."""

from __future__ import annotations

from tessergraph.llm import archive, lengths, packing, pieces, quality, secrets, shards, simhash, topk, toxicity

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality": quality.op3_quality,
    "op4_pieces": pieces.op4_pieces,
    "op5_simhash": simhash.op5_simhash,
    "op6_shards": shards.op6_shards,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc": archive.op8_warc,
    "op9_lengths": lengths.op9_lengths,
    "op10_packing": packing.op10_packing,
}
ORACLES = {"op1_topk": topk.OP1_SQL, "op8_warc": archive.OP8_SQL}
