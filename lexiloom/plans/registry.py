"""All queries of the analytics operators and the SQL each must agree with."""

from __future__ import annotations

from . import analysis, features, relational, splits, text, vocabulary  # noqa: F401  they register their queries
from .common import QUERIES, SQL  # noqa: F401
