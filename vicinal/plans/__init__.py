"""Compositions of operators: the analysis of timing runs, and the registered queries."""
