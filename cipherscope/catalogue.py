"""All registered queries of the cryptographic operators."""

from . import queries_documents, queries_extract, queries_files, queries_source  # noqa: F401  register their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
