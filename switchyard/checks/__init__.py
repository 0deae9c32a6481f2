"""Queries over the shared test tables, each next to the SQL that must give the same rows."""

from __future__ import annotations


def catalogue():
    """All registered queries by name."""
    from switchyard.checks import (  # noqa: F401
        data_checks, eval_checks, feature_checks, model_checks, review_checks, stream_checks,
    )
    from switchyard.checks.base import CHECKS

    return CHECKS
