"""Operators on signals.

A signal is a table (series, idx, v) without nulls, idx counting from 0 without gaps in each series; signal.from_events
makes one, and leaves out events without key, id or value. An empty signal gives an empty result. Results have the columns
that an operator names; other columns of its input go on only where it says so. Repeated (series, idx) are not a signal.
"""
