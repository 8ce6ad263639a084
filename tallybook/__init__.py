"""Tallybook: statement-coverage analytics as composable PySpark DataFrame operators."""
