"""The corpus queries and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, language_id, line_dedup, minhash, mixing, mpeg_audio, ngram_join, prefix_trie, toxicity, url_filter, warc


def queries() -> dict:
    """opN of the N-th operator. op3, op5, op6, op8 and op10 are beyond SQL; tests hold them against brute force,
    exact round trips or held-out labels."""
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_warc_derivatives": warc.op3_warc_derivatives,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_mpeg_audio": mpeg_audio.op8_mpeg_audio,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_minhash_dedup": minhash.op11_minhash_dedup,
        "op12_conversation_trie": prefix_trie.op12_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op7_ngram_join": ngram_join.OP7_SQL,
        "op9_chat_format": chat_format.OP9_SQL,
        "op11_minhash_dedup": minhash.OP11_SQL,
        "op12_conversation_trie": prefix_trie.OP12_SQL,
    }
