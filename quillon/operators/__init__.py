"""Relational operators over DataFrames with a logical schema."""
