"""Spark-native analytics over agent conversations, notes, ledgers and record logs."""
