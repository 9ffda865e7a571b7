"""The corpus queries by name, and SQL where it can express them."""

from . import ann, bpe, chat, packing, quality, secrets, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_warc": warc.op8_warc,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_token_counts": token_counts.op10_token_counts,
}
SQL = {
    "op2_chat_formatting": chat.OP2_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
}
