"""Operators: DataFrame -> DataFrame functions over the content tables."""
