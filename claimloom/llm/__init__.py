"""Operations of a large-scale training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from . import catalog

    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    from . import catalog

    return dict(catalog.ORACLES)
