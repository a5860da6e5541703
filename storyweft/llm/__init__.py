"""Operators for preparing training data.

Nothing outside this folder imports it. ``entries`` holds the registered
queries and their SQL.
"""
