"""Relational operators: every one maps DataFrames to DataFrames and stays lazy unless its docstring says otherwise."""
