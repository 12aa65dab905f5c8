"""Operators for preparing training text: rules, near copies, private data, mixing, sharding, scoring."""
