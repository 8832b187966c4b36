"""Operators that prepare training data: extraction, quality, de-duplication, mixing, sharding.

Nothing outside this folder imports it.
"""
