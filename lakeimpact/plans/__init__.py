"""Operators put together: the table pipeline and the change audit."""
