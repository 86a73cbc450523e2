"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import days, ledger, outlook, sequences, signals

QUERIES: dict = sequences.QUERIES | days.QUERIES | signals.QUERIES | ledger.QUERIES | outlook.QUERIES
ORACLES: dict[str, str] = sequences.ORACLES | days.ORACLES | signals.ORACLES | ledger.ORACLES | outlook.ORACLES
