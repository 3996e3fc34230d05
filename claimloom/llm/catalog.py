"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import filter_audit, licenses, mixing, vector_codes
from .filter_audit import op13_filter_audit
from .html_text import op2_html_extraction
from .language import op10_language_id
from .licenses import op6_license_scan
from .mixing import op7_source_mixing
from .neighbours import op3_nearest_neighbours
from .packing import op5_best_fit_packing
from .quality import op1_quality_classifier
from .rules import op9_quality_rules
from .secrets import op11_secret_scan
from .simhash import op4_simhash_near_dedup
from .token_codes import op8_token_codes
from .vector_codes import op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_html_extraction, op3_nearest_neighbours, op4_simhash_near_dedup, op5_best_fit_packing, op6_license_scan, op7_source_mixing, op8_token_codes, op9_quality_rules, op10_language_id, op11_secret_scan, op12_vector_codes, op13_filter_audit)}
ORACLES: dict[str, str] = {"op6_license_scan": licenses.oracle_sql(), "op7_source_mixing": mixing.ORACLE_SQL, "op12_vector_codes": vector_codes.oracle_sql(), "op13_filter_audit": filter_audit.ORACLE_SQL}
