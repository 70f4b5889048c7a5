"""Queries of the text operators, and their SQL where SQL can say them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, digest, edits, forest, licences, prefixes, pseudo, repair, secrets, simhash, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_chat": chat.op1_chat, "op2_bpe": bpe.op2_bpe, "op3_pseudo": pseudo.op3_pseudo, "op4_toxicity": toxicity.op4_toxicity, "op5_simhash": simhash.op5_simhash,
        "op6_licences": licences.op6_licences, "op7_edits": edits.op7_edits, "op8_secrets": secrets.op8_secrets, "op9_decontaminate": decontaminate.op9_decontaminate, "op10_digest": digest.op10_digest,
        "op11_repair": repair.op11_repair, "op12_prefixes": prefixes.op12_prefixes, "op13_forest": forest.op13_forest, "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op6_licences": licences.OP6_SQL, "op11_repair": repair.OP11_SQL, "op12_prefixes": prefixes.OP12_SQL}
