"""What several test modules share; a module of its own name, as every test folder may have a conftest."""


def rows(df):
    """Rows as tuples, in no particular order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
