"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import evaluation, evidence, operations, stores, telemetry

MODULES = (operations, evidence, telemetry, stores, evaluation)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
