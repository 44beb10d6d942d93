"""Operators of a training-data pipeline. Nothing outside this folder imports them, but for the entry module's guard."""
