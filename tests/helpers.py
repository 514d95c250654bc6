"""Helpers that several test modules share."""


def values(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r) for r in df.select(*columns).collect())
