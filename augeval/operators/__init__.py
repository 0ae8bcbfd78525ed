"""DataFrame operators: ``f(df, ...) -> DataFrame``; none collects to the driver."""
