"""Spindrift: a PySpark-native engine for digest analytics over event logs."""
