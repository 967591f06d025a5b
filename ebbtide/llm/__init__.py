"""Operators of a training-data pipeline over text, and their registered queries.

``QUERIES`` and ``ORACLES`` are filled by the operator modules.
"""

from ebbtide.llm import (  # noqa: F401
    digests, exact_duplicates, language_model, languages, mixing, near_duplicates, packing, pages, periodic_runs, quality, spelling_variants,
    token_counts, token_files,
)
from ebbtide.llm.common import ORACLES, QUERIES  # noqa: F401
