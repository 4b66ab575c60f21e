"""The front end: types, lexer, parser and binder. It knows nothing of Spark's execution."""
