"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

import importlib

from cartloom.plans import problems

QUERIES, SQL = dict(problems.QUERIES), dict(problems.SQL)
for _name in ("windows", "relational", "texts", "metrics", "baskets", "pipelines", "features"):
    _module = importlib.import_module(f"cartloom.plans.{_name}")
    QUERIES |= _module.R.queries
    SQL |= _module.R.sql
