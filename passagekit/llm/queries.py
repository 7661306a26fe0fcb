"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, debruijn, mixing, multi_index, pii, radix_dedup, resharding, secret_scan, sentencepiece_codec, simhash, toxicity, warc, whitening
from .oracles import SQL

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_exact_dedup": radix_dedup.op3_exact_dedup,
    "op4_multi_index": multi_index.op4_multi_index,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_debruijn_dedup": debruijn.op8_debruijn_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_flow_reshard": resharding.op10_flow_reshard,
    "op11_warc_chain": warc.op11_warc_chain,
    "op12_centroids": centroids.op12_centroids,
    "op13_whitening": whitening.op13_whitening,
}

__all__ = ["QUERIES", "SQL"]
