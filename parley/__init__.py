"""Spark-native search and analytics over ordered dialogue and document corpora."""
