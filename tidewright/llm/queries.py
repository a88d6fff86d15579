"""The corpus operators' queries, each over its whole table, and the SQL of those that SQL can express."""

from . import chat, collocations, decontaminate, licenses, line_dedup, mixing, packing, quality, simhash, spelling, tiff, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup, mixing.op2_mixing, quality.op3_quality, decontaminate.op4_decontamination, token_counts.op5_token_counts,
        chat.op6_chat, simhash.op7_simhash, toxicity.op8_toxicity, tiff.op9_tiff, licenses.op10_licenses,
        collocations.op11_collocations, packing.op12_packing, spelling.op13_spelling)
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL, "op2_mixing": mixing.SQL, "op4_decontamination": decontaminate.SQL,
    "op6_chat": chat.SQL, "op10_licenses": licenses.SQL, "op11_collocations": collocations.SQL, "op13_spelling": spelling.SQL}
