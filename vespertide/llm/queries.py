"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from vespertide.llm.ann import op10_ann
from vespertide.llm.codes import OP13_SQL, op13_codes
from vespertide.llm.decontam import OP3_SQL, op3_decontamination
from vespertide.llm.licenses import OP7_SQL, op7_licenses
from vespertide.llm.linededup import op8_line_dedup
from vespertide.llm.pieces import op5_sentencepiece
from vespertide.llm.pii import op1_pii
from vespertide.llm.secrets import op6_secrets
from vespertide.llm.simhash import op9_simhash
from vespertide.llm.spelling import OP11_SQL, op11_spelling
from vespertide.llm.tokens import op2_token_counts
from vespertide.llm.toxicity import op4_toxicity
from vespertide.llm.urlfilter import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_ann": op10_ann,
    "op11_spelling": op11_spelling,
    "op12_url_filters": op12_url_filters,
    "op13_codes": op13_codes,
}

ORACLE_SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op7_licenses": OP7_SQL, "op11_spelling": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_codes": OP13_SQL}
