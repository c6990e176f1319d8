"""Trajectory analytics on Spark: operators as plain DataFrame and Column transformations."""
