"""The functions of the statistic language."""
