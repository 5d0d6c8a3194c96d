"""fieldmark: a Spark-native analytics engine for a multi-competition sports warehouse."""
