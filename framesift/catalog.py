"""Registered queries of the selection and evaluation operators, each with its SQL oracle."""

from __future__ import annotations

from framesift.plans import ORACLES, QUERIES, agents, analytics, files, joins, onepass, sampling, scoring, selection  # noqa: F401  (they register)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
