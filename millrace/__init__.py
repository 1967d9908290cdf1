"""millrace: Spark-native analytics over job adverts, their requirements and titles."""

__version__ = "0.1.0"
