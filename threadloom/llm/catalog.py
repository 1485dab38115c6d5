"""Every query of this package, and its SQL."""

from __future__ import annotations

from threadloom.llm import queries_graph, queries_text

QUERIES = {**queries_graph.QUERIES, **queries_text.QUERIES}
SQL = {**queries_graph.SQL, **queries_text.SQL}
