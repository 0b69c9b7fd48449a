"""Signal-survey analytics on Spark: DataFrame and Column operators for indoor radio surveys."""
