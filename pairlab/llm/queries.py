"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .chat import op5_chat_formatting
from .extraction import OP12_SQL, op12_html_extraction
from .language import op7_language_id
from .linededup import OP1_SQL, op1_line_dedup
from .manifest import OP13_SQL, op13_merkle_manifest
from .mixing import OP4_SQL, op4_source_mixing
from .packing import op2_best_fit_packing
from .prefixhash import op8_document_fingerprints
from .quality import OP9_SQL, op9_quality_rules
from .secrets import op3_secret_scans
from .simhash import op6_simhash_near_dedup
from .tokencounts import op10_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_best_fit_packing,
        op3_secret_scans,
        op4_source_mixing,
        op5_chat_formatting,
        op6_simhash_near_dedup,
        op7_language_id,
        op8_document_fingerprints,
        op9_quality_rules,
        op10_token_counts,
        op11_filter_audit,
        op12_html_extraction,
        op13_merkle_manifest,
    )
}
SQL = {"op1_line_dedup": OP1_SQL, "op4_source_mixing": OP4_SQL, "op9_quality_rules": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_html_extraction": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
