"""Spark-native retrieval, memory, conversation-window and evaluation operators over DataFrames."""
