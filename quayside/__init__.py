"""Delivery-analytics lakehouse: contracts, validation, facts, answers and audit as Spark DataFrame functions."""
