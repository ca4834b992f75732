"""Point-in-time analytics over daily market data, as lazy Spark DataFrames."""
