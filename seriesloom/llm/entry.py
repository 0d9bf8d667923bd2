"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import decontamination, licenses, lines, packing, quality, sharding, simhash, toxicity, vptree, warc


def queries() -> dict:
    return {
        "op1_vptree": vptree.op1_vptree,
        "op2_licenses": licenses.op2_licenses,
        "op3_sharding": sharding.op3_sharding,
        "op4_quality": quality.op4_quality,
        "op5_simhash": simhash.op5_simhash,
        "op6_lines": lines.op6_lines,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_warc": warc.op8_warc,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict:
    return {
        "op1_vptree": vptree.OP1_SQL,
        "op2_licenses": licenses.OP2_SQL,
        "op3_sharding": sharding.OP3_SQL,
        "op7_decontamination": decontamination.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
    }
