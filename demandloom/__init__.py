"""Demand forecasting and pricing analytics as composable PySpark DataFrame operators."""
