"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, jaccard_join, media, mixing, sharding, token_counts, toxicity, url_reputation, warc

QUERIES = {
    "op1_url_reputation": url_reputation.query,
    "op2_pareto_mix": mixing.query,
    "op3_reply_trees": chat.query,
    "op4_warc_writer": warc.query,
    "op5_media_tiles": media.query,
    "op6_token_groups": jaccard_join.query,
    "op7_noisy_channel": toxicity.query,
    "op8_fm_index": decontamination.query,
    "op9_label_propagation": sharding.query,
    "op10_token_trees": token_counts.query,
}
ORACLES = {
    "op1_url_reputation": url_reputation.ORACLE,
    "op2_pareto_mix": mixing.ORACLE,
    "op3_reply_trees": chat.ORACLE,
    "op4_warc_writer": warc.ORACLE,
    "op5_media_tiles": media.ORACLE,
    "op8_fm_index": decontamination.ORACLE,
}
