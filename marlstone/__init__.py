"""A Spark-first analytics library: dataframe operators, sources, time series, content statistics."""
