"""A Spark-native relational and full-text query engine."""
