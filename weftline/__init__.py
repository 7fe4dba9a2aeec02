"""Spark-native analytics over typed knowledge graphs and their source documents."""
