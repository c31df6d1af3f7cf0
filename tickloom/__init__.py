"""Analytics for market-style time series on PySpark."""
