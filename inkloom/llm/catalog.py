"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .curve_clusters import OP11_SQL, op11_curve_clusters
from .decision_rules import op9_decision_list
from .decontaminate import OP6_SQL, op6_decontaminate
from .fuzzy_lines import op10_fuzzy_lines
from .lexical_search import OP12_SQL, op12_ranked_search
from .licenses import op8_license_templates
from .near_dup import op2_near_duplicates
from .pieces import op3_sentencepiece
from .quality_classifier import op4_quality_rules
from .secrets import op7_secrets
from .token_counts import op13_token_counts
from .toxicity import op1_toxic_spans
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_toxic_spans": op1_toxic_spans,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_license_templates": op8_license_templates,
    "op9_decision_list": op9_decision_list,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_curve_clusters": op11_curve_clusters,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}

ORACLE = {
    "op5_warc": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op11_curve_clusters": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
