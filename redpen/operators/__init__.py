"""Relational operators: findings, issues, cross-references, locating, ranking, reports, run state."""
