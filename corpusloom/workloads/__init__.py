"""Registered queries over the given tables, each with an independent SQL statement."""

from __future__ import annotations

from corpusloom.workloads import files, graph, search, streams, text, upkeep

ALL = {**text.QUERIES, **search.QUERIES, **upkeep.QUERIES, **graph.QUERIES, **streams.QUERIES, **files.QUERIES}
