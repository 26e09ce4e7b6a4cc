"""Every query of the engine by name, with the SQL that checks it where SQL can."""

from __future__ import annotations

from lodestone.plans import queries_graph, queries_rank, queries_state, queries_text

_MODULES = (queries_text, queries_rank, queries_graph, queries_state)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.BOOK.queries.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.BOOK.oracles.items()}
