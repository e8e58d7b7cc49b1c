"""The queries of this package and, where SQL can say it, their counterparts."""
from __future__ import annotations

from .decontaminate import OP9_SQL, op9_benchmark_decontamination
from .fingerprints import OP12_SQL, op12_document_fingerprints
from .jaccard import OP10_SQL, op10_ngram_jaccard
from .licenses import op6_license_scan
from .packing import op3_packing
from .passages import op5_repeated_passages
from .periodic import OP13_SQL, op13_periodic_runs
from .phrases import OP11_SQL, op11_phrase_collocations
from .pii import op1_pii
from .quality import op7_quality_rules
from .secrets import op8_secret_scan
from .toxicity import op4_toxicity
from .urls import op2_url_filter

QUERIES = {f.__name__: f for f in (op1_pii, op2_url_filter, op3_packing, op4_toxicity, op5_repeated_passages, op6_license_scan, op7_quality_rules, op8_secret_scan, op9_benchmark_decontamination, op10_ngram_jaccard,
                                   op11_phrase_collocations, op12_document_fingerprints, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op9_benchmark_decontamination": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op12_document_fingerprints": OP12_SQL, "op13_periodic_runs": OP13_SQL}
