"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from convlake.llm import cws, decontaminate, exactdup, fixity, langid, licences, simhash, spm, tokenalign, tokenfile, urlfilter, vectorcode, wrappers

QUERIES = {
    "op1_fixity": fixity.op1_fixity,
    "op2_language_id": langid.op2_language_id,
    "op3_sentencepiece": spm.op3_sentencepiece,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_token_file": tokenfile.op5_token_file,
    "op6_html_wrappers": wrappers.op6_html_wrappers,
    "op7_simhash": simhash.op7_simhash,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_fingerprints": cws.op9_fingerprints,
    "op10_licences": licences.op10_licences,
    "op11_vector_codes": vectorcode.op11_vector_codes,
    "op12_exact_dedup": exactdup.op12_exact_dedup,
    "op13_token_alignment": tokenalign.op13_token_alignment,
}

ORACLE_SQL = {
    "op1_fixity": fixity.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_url_filter": urlfilter.OP8_SQL,
    "op11_vector_codes": vectorcode.OP11_SQL,
    "op12_exact_dedup": exactdup.OP12_SQL,
}
