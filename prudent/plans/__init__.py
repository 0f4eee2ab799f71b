"""Query plans over the driver tables (one module per inventory family)."""

from prudent.plans.registry import ORACLE, QUERIES  # noqa: F401


def load_all():
    """Import every query module so that the registry is populated."""
    from prudent.plans import (  # noqa: F401
        q_relational,
        q_window,
        q_text,
        q_profile,
        q_stats,
        q_models,
        q_diagnose,
        q_benchmark,
        q_series,
        q_breaks,
        q_findings,
        q_artifacts,
        q_cluster,
        q_robust,
        q_io,
        q_stream,
        q_extra,
    )
    return QUERIES, ORACLE
