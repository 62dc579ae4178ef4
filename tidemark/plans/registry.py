"""All registered queries of the library, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.plans import basics, graphs, ingest, market, sources, text, trends, vectors

MODULES = [basics, trends, market, text, vectors, graphs, sources, ingest]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
