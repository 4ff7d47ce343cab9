"""Every registered query of the engine, with its SQL where SQL can express it."""

from __future__ import annotations

from .plans import changes, gates, graphs, libraries, versions

QUERIES, SQL = {}, {}
for _module in (changes, versions, graphs, gates, libraries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
