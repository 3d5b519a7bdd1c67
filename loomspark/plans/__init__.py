"""Named queries over the standard tables."""

from __future__ import annotations

from functools import lru_cache

from loomspark.catalog import Catalog


@lru_cache(maxsize=1)
def core_catalog() -> Catalog:
    """All queries of the core library (the optional subpackages register their own)."""
    from loomspark.plans import corpus, files, packing, runs, tracking, training

    catalog = Catalog()
    for module in (corpus, files, packing, runs, tracking, training):
        module.register(catalog)
    return catalog
