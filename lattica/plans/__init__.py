"""Logical plans: the code graph and the queries over it."""
