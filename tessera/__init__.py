"""tessera: a Spark-native analytics engine (DataFrames, Spark SQL, Catalyst)."""

__version__ = "0.1.0"
