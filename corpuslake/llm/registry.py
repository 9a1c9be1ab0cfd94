"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from corpuslake.llm.decontaminate import OP3_SQL, op3_decontaminate
from corpuslake.llm.divergence import OP11_SQL, op11_divergence
from corpuslake.llm.fingerprints import op13_fingerprints
from corpuslake.llm.graph_search import op10_graph_search
from corpuslake.llm.language_id import op9_language_id
from corpuslake.llm.licenses import op2_licenses
from corpuslake.llm.line_dedup import OP7_SQL, op7_line_dedup
from corpuslake.llm.merkle import OP12_SQL, op12_manifest
from corpuslake.llm.mixing import op4_mix
from corpuslake.llm.near_dedup import OP6_SQL, op6_near_dedup
from corpuslake.llm.secrets import op5_secrets
from corpuslake.llm.suffix_dedup import op8_suffix_dedup
from corpuslake.llm.surrogates import op1_surrogates

QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix": op4_mix,
    "op5_secrets": op5_secrets,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_graph_search": op10_graph_search,
    "op11_divergence": op11_divergence,
    "op12_manifest": op12_manifest,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op6_near_dedup": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_divergence": OP11_SQL,
    "op12_manifest": OP12_SQL,
}
