"""Operators over DataFrames of boards (player, opponent, ...)."""
