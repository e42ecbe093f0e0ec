"""A Spark-native engine for topographic downscaling of gridded weather data."""
