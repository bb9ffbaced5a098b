"""Queries of this subpackage and their SQL; the thirteen operators and the pipeline."""

from __future__ import annotations

from . import alignment, ann, decontamination, licenses, neardup, packing, periodic, pii, sharding, suffix_dedup, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op4_packing": packing.op4_packing,
        "op9_decontamination": decontamination.op9_decontamination,
        "op6_minhash": neardup.op6_minhash,
        "op10_toxicity": toxicity.op10_toxicity,
        "op2_nearest": ann.op2_nearest,
        "op3_token_counts": token_counts.op3_token_counts,
        "op5_licenses": licenses.op5_licenses,
        "op7_pii": pii.op7_pii,
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op11_alignment": alignment.op11_alignment,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_warc": warc.op13_warc,
    }


def oracles() -> dict:
    return {
        "op6_minhash": neardup.OP6_SQL,
        "op9_decontamination": decontamination.OP9_SQL,
        "op13_warc": warc.OP13_SQL,
    }
