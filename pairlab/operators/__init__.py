"""Relational operators: records, pairs, cohorts, aggregates, screening, matching, contracts, parity."""
