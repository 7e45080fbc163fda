"""Spark-native analytics for agent-session memory."""
