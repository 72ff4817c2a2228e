"""Training-data operators and their registered queries.

`load()` imports the query modules; each adds its query, and its reference SQL where SQL can express it, to the tables here.
Nothing else in the library imports this package.
"""

import importlib

from tidemark.llm.common import ORACLES, QUERIES

_MODULES = ("token_files", "embedding_links", "source_mix", "language_id", "jaccard_join", "url_filter", "suffix_tree", "packing", "license_scan", "exact_dedup", "suffix_dedup", "periodic_runs", "token_alignment")


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
