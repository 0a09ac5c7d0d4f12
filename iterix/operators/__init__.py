"""Runners: a statistic over the whole of a DataFrame, its groups or its windows."""
