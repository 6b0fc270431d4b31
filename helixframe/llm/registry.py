"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import ann, byte_bpe, exact_dedup, language_id, mixing, shard_store, simhash, token_count, token_shards, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_language_id": language_id.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_count": token_count.op7_token_count,
    "op8_ann": ann.op8_ann,
    "op9_sharding": shard_store.op9_sharding,
    "op10_token_shards": token_shards.op10_token_shards,
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op4_mixing": mixing.SQL}
