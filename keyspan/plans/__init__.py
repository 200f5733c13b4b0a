"""The query catalogue and the SQL that checks it."""

from keyspan.plans import catalogue, oracles, whole_answers

QUERIES = catalogue.QUERIES | whole_answers.QUERIES
ORACLES = oracles.ORACLES | whole_answers.ORACLES

__all__ = ["ORACLES", "QUERIES"]
