"""Named queries over the driver tables, each with its SQL check."""

from __future__ import annotations

from gazette.plans import (  # noqa: F401
    base,
    cleaning,
    exploration,
    labelling,
    models,
    scoring,
    serving,
    storage,
    texts,
)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return base.oracle_sql()
