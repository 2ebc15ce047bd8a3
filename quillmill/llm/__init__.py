"""Operators that prepare text and code for training; nothing outside this folder imports it."""
