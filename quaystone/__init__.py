"""Disclosure analytics as Spark DataFrame operators."""
