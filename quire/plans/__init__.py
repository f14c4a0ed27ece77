"""The registered queries over the engine's operators, and the same in SQL."""

from __future__ import annotations

from quire.plans import books, decisions, lines, streams

QUERIES = {**lines.QUERIES, **books.QUERIES, **decisions.QUERIES, **streams.QUERIES}
SQL = {**lines.SQL, **books.SQL, **decisions.SQL, **streams.SQL}
