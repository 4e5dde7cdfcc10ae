"""Queries of this subpackage and their DuckDB equivalents, for the repository's entry points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .filter_audit import OP12_SQL, op12_filter_audit
from .flat_graph import op1_flat_graph
from .jaccard_join import op7_jaccard_join
from .language_net import op13_language_net
from .mixing import OP10_SQL, op10_mixing
from .packing import op9_packing
from .secret_scan import op4_secret_scan
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .substring_dedup import op3_substring_dedup
from .token_counts import op5_token_counts
from .topk_search import OP6_SQL, op6_topk_search
from .toxicity import op2_toxicity
from .url_filter import OP8_SQL, op8_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_flat_graph, op2_toxicity, op3_substring_dedup, op4_secret_scan, op5_token_counts, op6_topk_search, op7_jaccard_join, op8_url_filter, op9_packing, op10_mixing, op11_spelling_variants, op12_filter_audit, op13_language_net)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk_search": OP6_SQL, "op8_url_filter": OP8_SQL, "op10_mixing": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_filter_audit": OP12_SQL}
