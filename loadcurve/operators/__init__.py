"""DataFrame operators: each is ``f(df, ..., as_of=None, by=()) -> DataFrame``."""
