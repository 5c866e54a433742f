"""Operators of a training-corpus pipeline; nothing outside this subpackage imports it."""
