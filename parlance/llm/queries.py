"""Queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .codes import op11_filtering_lloyd
from .findings import op12_secret_network
from .html import op7_host_wrappers
from .jaccard import op5_partition_jaccard
from .langid import op10_marginal_unigrams
from .packing import op9_histogram_packing
from .pieces import op3_max_plus_pieces
from .quality import op2_quality_cascade
from .sharding import op4_virtual_slot_sharding
from .syncmers import op1_closed_syncmers
from .trie import op13_prefix_doubling_trie
from .urls import op8_host_reputation
from .warc import op6_revisit_archives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_closed_syncmers": op1_closed_syncmers,
        "op2_quality_cascade": op2_quality_cascade,
        "op3_max_plus_pieces": op3_max_plus_pieces,
        "op4_virtual_slot_sharding": op4_virtual_slot_sharding,
        "op5_partition_jaccard": op5_partition_jaccard,
        "op6_revisit_archives": op6_revisit_archives,
        "op7_host_wrappers": op7_host_wrappers,
        "op8_host_reputation": op8_host_reputation,
        "op9_histogram_packing": op9_histogram_packing,
        "op10_marginal_unigrams": op10_marginal_unigrams,
        "op11_filtering_lloyd": op11_filtering_lloyd,
        "op12_secret_network": op12_secret_network,
        "op13_prefix_doubling_trie": op13_prefix_doubling_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_cascade": oracles.QUALITY,
        "op6_revisit_archives": oracles.REVISITS,
        "op8_host_reputation": oracles.HOSTS,
        "op11_filtering_lloyd": oracles.LLOYD,
        "op13_prefix_doubling_trie": oracles.TRIE,
    }
