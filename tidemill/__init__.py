"""Analytics pipelines on Spark: typed, composable operators over DataFrames."""
