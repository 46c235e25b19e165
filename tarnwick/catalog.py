"""All registered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from tarnwick.functions import queries as _functions  # noqa: F401
from tarnwick.operators import queries as _operators  # noqa: F401
from tarnwick.plans import relational as _relational  # noqa: F401
from tarnwick.registry import ORACLE_SQL, QUERIES  # noqa: F401
from tarnwick.sources import queries as _sources  # noqa: F401
from tarnwick.streaming import queries as _streaming  # noqa: F401
from tarnwick.streaming import replay as _replay  # noqa: F401
