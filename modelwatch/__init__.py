"""Model monitoring and retraining analytics as Spark DataFrame operators."""
