"""Registered queries: every operator run over the given tables, with the SQL
that checks it. ``QUERIES`` and ``ORACLES`` collect the modules."""

from tabweave.plans import encoding, generating, mixing, preparing, reporting, resampling, scoring, tables

_MODULES = (tables, preparing, encoding, resampling, generating, scoring, mixing, reporting)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
