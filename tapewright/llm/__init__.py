"""Operators for building training corpora: one module per operator, the
registered queries in ``queries`` and their oracle SQL in ``oracles``."""
