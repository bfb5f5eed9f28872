"""The queries of this subpackage and the SQL that checks them, for the entry module at the repository's top."""

import corpus_pipeline

from . import caps, chat, kneser_ney, mixing, packing, quality_rules, simhash, suffix_dedup, token_files, warc

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_spherical_caps": caps.op2_spherical_caps,
    "op3_quality_classifier": kneser_ney.op3_quality_classifier,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_files": token_files.op8_token_files,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_packing": packing.op10_packing,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
}
