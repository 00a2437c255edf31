"""Name -> query and name -> oracle SQL of the training-data operators."""

from __future__ import annotations

from matchgrid.llm import embed_dup, language, licences, merkle, mixing, near_dup, oracles, packing, prefix_trie, quality, secrets, tokens, toxicity, warc
from matchgrid.llm.common import together

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_warc": warc.op2_warc,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_embeddings": embed_dup.op5_embeddings,
    "op6_tokens": tokens.op6_tokens,
    "op7_licences": licences.op7_licences,
    "op8_quality": quality.op8_quality,
    "op9_minhash": near_dup.op9_minhash,
    "op10_language": language.op10_language,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_merkle": merkle.op13_merkle,
}
QUERIES = {name: together(query) for name, query in QUERIES.items()}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_embeddings": oracles.OP5_SQL,
    "op8_quality": oracles.OP8_SQL,
    "op9_minhash": oracles.OP9_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
