"""Rows as texts, for comparing two engines' results."""


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(df):
    """Rows as a sorted list, columns by name, floats rounded."""
    names = sorted(df.columns)
    return sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
