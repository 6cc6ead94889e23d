"""A Spark-native analytics engine: typed query specifications compiled to lazy DataFrames."""
