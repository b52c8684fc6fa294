"""Spark-native operators on gridded time series held as tables of cells."""
