"""Ticket retrieval and analytics on Spark DataFrames."""
