"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from orelode.llm.bpe import op6_bpe
from orelode.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from orelode.llm.fingerprints import op2_fingerprints
from orelode.llm.langid import op4_language_id
from orelode.llm.near_dedup import op8_near_dedup
from orelode.llm.packing import op3_packing
from orelode.llm.pii import op10_pii_surrogates
from orelode.llm.suffix_dedup import op7_suffix_dedup
from orelode.llm.token_output import op5_token_output
from orelode.llm.url_filter import OP9_SQL, op9_url_filter


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_fingerprints": op2_fingerprints,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_token_output": op5_token_output,
        "op6_bpe": op6_bpe,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_pii_surrogates": op10_pii_surrogates,
    }


def oracle_sql():
    return {"op1_exact_dedup": OP1_SQL, "op9_url_filter": OP9_SQL}
