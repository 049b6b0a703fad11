"""Queries of this subpackage, as (name, function) and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import exactdedup, fillmiddle, langid, linededup, lloyd, mixing, neardup, ngramjoin, packing, suffixdedup, topk, toxicity, warc


def queries() -> dict:
    return {"op1_ngramjoin": ngramjoin.op1_ngramjoin, "op2_neardup": neardup.op2_neardup, "op3_suffixdedup": suffixdedup.op3_suffixdedup, "op4_mixing": mixing.op4_mixing, "op5_packing": packing.op5_packing, "op6_linededup": linededup.op6_linededup, "op7_langid": langid.op7_langid, "op8_toxicity": toxicity.op8_toxicity, "op9_topk": topk.op9_topk, "op10_warc": warc.op10_warc, "op11_lloyd": lloyd.op11_lloyd, "op12_fillmiddle": fillmiddle.op12_fillmiddle, "op13_exactdedup": exactdedup.op13_exactdedup}


def oracle_sql() -> dict[str, str]:
    return {"op6_linededup": linededup.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op11_lloyd": lloyd.ORACLE_SQL, "op12_fillmiddle": fillmiddle.ORACLE_SQL, "op13_exactdedup": exactdedup.ORACLE_SQL}
