"""Spark-native analytics over collections of public comments and agency documents."""
