"""Session-demand analytics as composable PySpark DataFrame operators."""
