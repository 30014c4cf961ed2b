"""The operators' queries and their SQL."""

from __future__ import annotations

from sievework.llm import bagminhash, bpe, chat, collocations, decontaminate, divergence, langid, lines, pii, sharding, topk, toxicity, urlfilter

QUERIES = {
    "op1_spaced_seeds": decontaminate.op1_spaced_seeds,
    "op2_word_first_backoff": langid.op2_word_first_backoff,
    "op3_bagminhash": bagminhash.op3_bagminhash,
    "op4_deletion_neighbourhood": lines.op4_deletion_neighbourhood,
    "op5_prefix_bpe": bpe.op5_prefix_bpe,
    "op6_sampled_splitters": sharding.op6_sampled_splitters,
    "op7_noisy_or": toxicity.op7_noisy_or,
    "op8_histogram_topk": topk.op8_histogram_topk,
    "op9_call_linking": chat.op9_call_linking,
    "op10_surrogates": pii.op10_surrogates,
    "op11_stripes": divergence.op11_stripes,
    "op12_de_bruijn": collocations.op12_de_bruijn,
    "op13_url_grams": urlfilter.op13_url_grams,
}

ORACLE_SQL = {
    "op1_spaced_seeds": decontaminate.SEEDS_SQL,
    "op8_histogram_topk": topk.TOPK_SQL,
    "op9_call_linking": chat.CHAT_SQL,
    "op11_stripes": divergence.STRIPES_SQL,
    "op12_de_bruijn": collocations.DE_BRUIJN_SQL,
}
