"""All registered queries and oracles, by key."""

from __future__ import annotations

import importlib

FAMILIES = ["analytics", "grading", "sql_texts", "context", "records", "files", "profiles", "explorations"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in FAMILIES:
    _family = importlib.import_module(f"plumbline.plans.{_name}")
    QUERIES.update(_family.QUERIES)
    ORACLES.update(_family.ORACLES)
