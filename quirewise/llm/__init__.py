"""Operators for preparing large training corpora, each built on Spark tables.

Nothing outside this folder imports it.
"""
