"""Scalar functions: every one takes Columns and returns a Column that stays in the JVM."""
