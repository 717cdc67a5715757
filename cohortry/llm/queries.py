"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from cohortry.llm.centroids import OP11_SQL, op11_bisector_kmeans
from cohortry.llm.dialogue import op12_lr_repair
from cohortry.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from cohortry.llm.line_dedup import OP1_SQL, op1_line_dedup
from cohortry.llm.mixing import OP9_SQL, op9_temperature_mixing
from cohortry.llm.packing import op4_best_fit_packing
from cohortry.llm.pii import op2_pii_supervision
from cohortry.llm.quality_rules import op8_quality_rules
from cohortry.llm.simhash import op10_simhash_covering
from cohortry.llm.token_counts import op5_viterbi_counts
from cohortry.llm.token_files import op3_seekable_tokens
from cohortry.llm.warc import OP13_SQL, op13_seekable_warc
from cohortry.llm.weighted_sampling import op7_weighted_sampling

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii_supervision": op2_pii_supervision,
    "op3_seekable_tokens": op3_seekable_tokens,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_viterbi_counts": op5_viterbi_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_weighted_sampling": op7_weighted_sampling,
    "op8_quality_rules": op8_quality_rules,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_simhash_covering": op10_simhash_covering,
    "op11_bisector_kmeans": op11_bisector_kmeans,
    "op12_lr_repair": op12_lr_repair,
    "op13_seekable_warc": op13_seekable_warc,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op9_temperature_mixing": OP9_SQL, "op11_bisector_kmeans": OP11_SQL, "op13_seekable_warc": OP13_SQL}
