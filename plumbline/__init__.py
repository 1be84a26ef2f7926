"""A Spark-native engine for dataset building, scoring, retrieval and calibration."""
