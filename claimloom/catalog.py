"""Every query of the engine by name, with the SQL that it must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.evidence", "operators.workflow", "operators.ranges", "operators.texts", "operators.retrieval", "operators.extents", "operators.aliases", "operators.ingest", "operators.web", "operators.access", "operators.lifecycle", "operators.delta", "operators.policies", "operators.gate", "streaming.flows", "sources.readers")


def _collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        found = getattr(import_module(f"claimloom.{name}"), kind)
        if clash := out.keys() & found.keys():
            raise ValueError(f"defined twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
