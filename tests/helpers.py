"""Rows of a DataFrame as plain tuples."""


def rows(df, *columns):
    """Sorted tuples of the given columns (all by default)."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
