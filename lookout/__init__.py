"""lookout: gazetteer search as Spark DataFrame operators.

Wildcard text search over any table, one display line per hit, per-query
top-k in bulk, debounced keystroke streams, and geometry / map-extent columns
for every hit.  See README.md.
"""

from .config import SearchConfig
from .functions.expressions import with_expression
from .functions.patterns import wildcard_pattern, wildcard_pattern_text
from .functions.suggest import suggestion
from .operators.batch import batch_search
from .operators.hits import with_geometry, with_viewport
from .operators.search import multi_search, search
from .streaming.debounce import (
    debounce,
    debounce_search,
    debounce_stream,
    latest_per_session,
    latest_stream,
    start_search_stream,
)

__all__ = [
    "SearchConfig",
    "batch_search",
    "debounce",
    "debounce_search",
    "debounce_stream",
    "latest_per_session",
    "latest_stream",
    "multi_search",
    "search",
    "start_search_stream",
    "suggestion",
    "wildcard_pattern",
    "wildcard_pattern_text",
    "with_expression",
    "with_geometry",
    "with_viewport",
]
