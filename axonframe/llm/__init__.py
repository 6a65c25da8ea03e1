"""Operators for large training-text tables.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns DataFrames;
``axonframe.llm.registry`` registers one query per operator.
"""
