"""Registered queries over the given tables."""

from fixatlas.workloads import (  # noqa: F401
    release_queries,
    text_queries,
    url_queries,
    page_queries,
    storage_queries,
    quality_queries,
    stream_queries,
)
from fixatlas.workloads.registry import EXPECTED, QUERIES  # noqa: F401
