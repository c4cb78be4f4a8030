"""Operators for training-data text and matching; nothing outside imports this subpackage."""
