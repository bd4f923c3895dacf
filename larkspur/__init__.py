"""larkspur: customer-event analytics as composable PySpark DataFrame operators."""
