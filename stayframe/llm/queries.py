"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import ann, chat, embedding_dedup, fim, langid, lm, minhash, mixing, pieces, quality, secret_scan, sharding, trie

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op2_embedding_duplicates": embedding_dedup.op2_embedding_duplicates,
    "op3_language_mixtures": langid.op3_language_mixtures,
    "op5_quality_scores": quality.op5_quality_scores,
    "op6_format_reply_trees": chat.op6_format_reply_trees,
    "op7_minhash_classes": minhash.op7_minhash_classes,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_shard_documents": sharding.op9_shard_documents,
    "op10_suffix_tree_scores": lm.op10_suffix_tree_scores,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_find_secrets": secret_scan.op12_find_secrets,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_embedding_duplicates": embedding_dedup.OP2_SQL,
    "op6_format_reply_trees": chat.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
