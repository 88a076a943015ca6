"""All registered queries and their SQL twins."""

from __future__ import annotations

from skyloom.plans import features, models, relational, sphere, statistics, timeseries

_PARTS = (relational, statistics, timeseries, sphere, features, models)
QUERIES: dict = {}
ORACLES: dict = {}
for _p in _PARTS:
    QUERIES |= _p.query.queries
    ORACLES |= _p.query.oracles
