"""Operators bound to tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from . import admission, association, binding, editing, gates, geometry, hierarchy, metrics, planning
from .common import Query

QUERIES: dict[str, Query] = {}
for _module in (geometry, association, hierarchy, binding, editing, metrics, planning, gates, admission):
    QUERIES |= _module.QUERIES
