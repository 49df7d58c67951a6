"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it. Each module holds one operator;
``queries`` has the thin ``opN_<name>`` queries and their DuckDB SQL.
"""
