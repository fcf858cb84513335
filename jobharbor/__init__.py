"""Spark-native ingestion and analytics for batch-job monitoring data and documentation."""
