"""Market analytics on Spark: bars, indicators, features, signals, research and ledgers as DataFrame jobs."""
