"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, langid, licenses, linededup, mixing, negatives, packing, pii, quality, simhash, spelling, suffix

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_licenses": licenses.op2_licenses,
    "op3_ann": ann.op3_ann,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_langid": langid.op7_langid,
    "op8_substrings": suffix.op8_substrings,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_negatives": negatives.op11_negatives,
    "op12_bpe": bpe.op12_bpe,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE = {"op4_quality": quality.SQL, "op5_line_dedup": linededup.SQL, "op9_mixing": mixing.SQL, "op11_negatives": negatives.SQL, "op13_spelling": spelling.SQL}
