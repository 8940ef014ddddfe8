"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from lakevault.llm import chat, embeddings, leaks, mix, ngram_join, substrings, suffixes, toxicity, urls, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_benchmark_leaks": leaks.op2_benchmark_leaks,
    "op5_embedding_neighbours": embeddings.op5_embedding_neighbours,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op6_source_mixing": mix.op6_source_mixing,
    "op7_url_rules": urls.op7_url_rules,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op9_warc_revisits": warc.op9_warc_revisits,
}
#: What op6 draws by lot SQL can't say; tests hold it against its invariants.
ORACLE_SQL = {
    "op2_benchmark_leaks": leaks.SQL,
    "op5_embedding_neighbours": embeddings.SQL,
    "op8_suffix_dedup": suffixes.SQL,
    "op3_substring_dedup": substrings.SQL,
    "op4_chat_formatting": chat.SQL,
    "op7_url_rules": urls.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op9_warc_revisits": warc.SQL,
}
