"""Operators: every one is ``(DataFrame, parameters) -> DataFrame`` without actions."""
