"""Operators for preparing training data of language models; nothing outside this folder imports it."""
