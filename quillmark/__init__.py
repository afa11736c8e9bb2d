"""Spark-native text provenance and stylometry engine."""
