"""The registered queries: each operator on the given tables, with SQL that checks it."""

from __future__ import annotations

from workloads import (  # noqa: F401
    analysis,
    basics,
    cleaning,
    edges,
    learning,
    storage,
    windows,
)
from workloads.base import REGISTRY

__all__ = ["REGISTRY"]
