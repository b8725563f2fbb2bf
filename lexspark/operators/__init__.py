"""Relational operators: counting, association, ranking, selection, replay, reconciliation."""
