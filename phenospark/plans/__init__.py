"""Whole plans: object creation, test inputs, registered queries and their SQL."""
