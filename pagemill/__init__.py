"""Spark-native page preparation, checking and reassembly at table scale."""
