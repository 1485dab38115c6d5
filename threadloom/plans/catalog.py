"""Every query outside the ``llm`` package, and its SQL."""

from __future__ import annotations

from threadloom.plans import checks, pipeline, problems, texts

QUERIES = {**pipeline.QUERIES, **checks.QUERIES, **texts.QUERIES, **problems.QUERIES}
SQL = {**pipeline.SQL, **checks.SQL, **texts.SQL, **problems.SQL}
