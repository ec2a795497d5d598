"""Every query of the library with its SQL, collected from the plan modules."""

from __future__ import annotations

from . import dialogue, documents, exchange, memory, records, search, transcripts, upkeep, usage

MODULES = (usage, search, records, documents, transcripts, memory, exchange, upkeep, dialogue)

QUERIES = {name: plan for module in MODULES for name, plan in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
