"""Operators for preparing language-model training data; nothing else in the library imports this."""

from graphloom.llm import plans

QUERIES, ORACLES = plans.QUERIES, plans.ORACLES
