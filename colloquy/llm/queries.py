"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op10_decontamination
from .language_id import op1_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .mixing import op9_mixing
from .nearest_neighbours import op12_nearest_neighbours
from .periodic_runs import op11_periodic_runs
from .pii import op6_pii
from .quality_classifier import op7_quality_classifier
from .quality_rules import op8_quality_rules
from .repeats import OP2_SQL, op2_substring_dedup
from .simhash import op3_simhash
from .suffix_index import op5_suffix_dedup
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_substring_dedup, op3_simhash, op4_token_counts, op5_suffix_dedup, op6_pii, op7_quality_classifier, op8_quality_rules, op9_mixing, op10_decontamination,
        op11_periodic_runs, op12_nearest_neighbours, op13_lexical_search,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op13_lexical_search": OP13_SQL}
