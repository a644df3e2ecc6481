"""Operators of a training-data pipeline over a corpus table ``documents``.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
