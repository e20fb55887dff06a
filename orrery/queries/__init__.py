"""All registered queries."""

from orrery.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "load"]


def load() -> tuple[dict, dict]:
    """Import the modules that register queries."""
    from orrery.queries import additions, distinguishing, dml, further, relational, scalars, systems  # noqa: F401

    return QUERIES, ORACLE
