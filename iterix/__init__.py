"""Iterated statistics on Spark: write a vector expression once, apply it to every group or window of a DataFrame."""

from iterix.operators.groups import group_exec, process_groups, run, run_exec
from iterix.operators.lowering import plan
from iterix.operators.windows import rollat_exec, rollbw_exec, rollby_exec, rolli_exec
from iterix.plans.compile import Stat, fn, reuse_calls, stat
from iterix.plans.tree import StatError

__all__ = ["Stat", "StatError", "fn", "group_exec", "plan", "process_groups", "reuse_calls", "rollat_exec", "rollbw_exec", "rollby_exec", "rolli_exec", "run", "run_exec", "stat"]
