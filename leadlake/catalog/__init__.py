"""Queries over registry tables that Spark derives from the given tables."""


def registered():
    """(queries, oracle SQL) of all query modules."""
    from leadlake.catalog import entry
    from leadlake.catalog import (  # noqa: F401
        cleaning_queries,
        geo_queries,
        lead_queries,
        load_queries,
        profile_queries,
        search_queries,
    )
    from leadlake.catalog import layout_queries, source_queries, store_queries  # noqa: F401

    return entry.QUERIES, entry.ORACLES
