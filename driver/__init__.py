"""Queries over the test tables, each with the SQL that must give the same rows."""


def registry() -> dict:
    """``name -> (spark callable, oracle SQL or None)``."""
    from driver import raster, records, vector

    return {**vector.QUERIES, **raster.QUERIES, **records.QUERIES}
