"""Meta-features of many univariate time series, as Spark plans."""
