"""Compositions of the operators: the full run, the analysis and the registered queries."""
