"""Operators for pipelines that prepare training text. Nothing outside imports this subpackage."""
