"""Queries over the star-schema tables: bindings of tables to operator inputs, and the queries built on them."""
