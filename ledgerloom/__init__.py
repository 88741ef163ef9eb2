"""Loan-tape and collateral analytics as Spark DataFrame operators."""
