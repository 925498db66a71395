"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from marlstone.plans import analytics, catalog, evaluation, recommendation, retrieval, textual  # noqa: F401
from marlstone.plans.base import QUERIES, SQL  # noqa: F401
