"""Query registry of the subpackage."""

from __future__ import annotations

from logweave.llm import chat, images, minhash, packing, pieces, quality, sharding, suffix_tree, toxicity, vectors

QUERIES = {
    "op1_minhash_dedup": minhash.query,
    "op2_sentencepiece": pieces.query,
    "op3_sharding": sharding.query,
    "op4_toxicity": toxicity.query,
    "op5_chat_format": chat.query,
    "op6_image_copies": images.query,
    "op7_quality_classifier": quality.query,
    "op8_suffix_tree": suffix_tree.query,
    "op9_packing": packing.query,
    "op10_embedding_dedup": vectors.query,
}
ORACLE: dict[str, str] = {"op1_minhash_dedup": minhash.ORACLE, "op5_chat_format": chat.ORACLE, "op10_embedding_dedup": vectors.ORACLE}
