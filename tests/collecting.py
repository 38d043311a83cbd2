"""Helpers of the tests; the fixtures are in conftest.py, which nothing imports."""


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
