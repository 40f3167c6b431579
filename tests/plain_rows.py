"""Rows of a DataFrame as plain tuples."""


def rows(df, *order):
    """Rows as plain tuples in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr) if not order else \
        [tuple(r) for r in df.orderBy(*order).collect()]
