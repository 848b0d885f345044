"""Feasibility of a board as a satisfiability problem and as a linear program, with solvers of their own."""
