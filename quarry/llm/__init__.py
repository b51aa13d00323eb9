"""Operators of a training-data pipeline; each module documents its contract."""
