"""What several test modules use."""


def rows(df):
    """Rows as a sorted list of tuples, for comparison without order."""
    return sorted((tuple(r) for r in df.collect()), key=str)
