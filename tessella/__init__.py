"""Spark-native engine that turns raw documents into a linked, audited knowledge base."""
