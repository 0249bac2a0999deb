"""The queries of this folder's operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from quill.llm import bpe, langid, lines, packing, rans, simhash, topk, toxicity, warc

QUERIES = {
    "op1_min_bin_slack_packing": packing.op1,
    "op2_bpe_automaton": bpe.op2,
    "op3_simhash_vantage_forest": simhash.op3,
    "op4_rans_token_file": rans.op4,
    "op5_language_id_byte_net": langid.op5,
    "op6_line_dedup": lines.op6,
    "op7_document_fingerprints": simhash.op7,
    "op8_toxicity_weak_supervision": toxicity.op8,
    "op9_warc_salvage": warc.op9,
    "op10_exact_top_k": topk.op10,
}
ORACLES = {
    "op9_warc_salvage": warc.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
}
