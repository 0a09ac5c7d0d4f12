"""Functions of whole vectors, recycled constants and loops, over the events of each user."""

from __future__ import annotations

from iterix.catalogue.common import Entry
from iterix.catalogue.groups import by

#: Events of each user in their order, and each user's number of events.
_E = "e AS (SELECT user_id, value AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
_LIST = "l AS (SELECT user_id, list(value ORDER BY event_id) AS x FROM events GROUP BY user_id)"


def users(source: str, more: dict | None = None) -> object:
    return by("events", source, {"x": "value"}, "user_id", 4, more, order="event_id")


def each(rows: str, value: str = "v", extra: str = _LIST) -> str:
    """SQL for a row for each element of a list of each user."""
    return f"WITH {extra}, r AS ({rows}) SELECT user_id, idx, round({value}, 4) AS value FROM r"


def _positions(array: str) -> str:
    return f"SELECT user_id, unnest({array}) AS v, generate_subscripts({array}, 1) AS idx FROM l"


CONVOLVE = """{
  out <- numeric_along(c(x, 0, 0))
  for (i in seq_along(x)) {
    for (j in seq_along(w)) out[i + j - 1] <- out[i + j - 1] + x[i] * w[j]
  }
  out
}"""

VECTORS: dict[str, Entry] = {
    "vector_subset": (users("x[c(1, 3, 100000)]"), each(_positions("[x[1], x[3], x[100000]]"))),
    "vector_concat": (users("c(sum(x), x, length(x))"), each(_positions("list_concat([list_sum(x)], x, [len(x)::DOUBLE])"))),
    "vector_rep_each": (users("rep(x, each = 2)"), each("SELECT user_id, x[(i + 1) // 2] AS v, i AS idx FROM (SELECT user_id, x, unnest(range(1, 2 * len(x) + 1)) AS i FROM l)")),
    "vector_rep_times": (users("rep(x, times = 2)"), each(_positions("list_concat(x, x)"))),
    "vector_rep_length": (users("rep(x, length.out = 10)"), each("SELECT user_id, x[(i - 1) % len(x) + 1] AS v, i AS idx FROM (SELECT user_id, x, unnest(range(1, 11)) AS i FROM l)")),
    "vector_subassign": (users("{ x[1] <- 1000; x[c(2, 3)] <- c(5, 6); sum(x[1], x[2], x[length(x)]) }"), "WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS x FROM events GROUP BY user_id), y AS (SELECT user_id, list_concat([1000, 5, 6], x[4:]) AS x FROM l) SELECT user_id, round(x[1] + x[2] + x[len(x)], 4) AS value FROM y"),
    "vector_numeric": (users("{ z <- numeric(length = 3); z[2] <- mean(x); z }"), "SELECT user_id, unnest([1, 2, 3])::INTEGER AS idx, unnest([0, round(m, 4), 0]) AS value FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)"),
    "vector_numeric_along": (users("{ z <- numeric_along(x); z[length(x)] <- sum(x); z }"), f"WITH {_E} SELECT user_id, k::INTEGER AS idx, round(CASE WHEN k = n THEN sum(x) OVER (PARTITION BY user_id) ELSE 0 END, 4) AS value FROM e"),
    "vector_numeric_alongn": (users("length(numeric_alongn(x, c(1, 2, 3)))"), "SELECT user_id, 3 * count(*) AS value FROM events GROUP BY user_id"),
    "vector_seq_along": (users("seq_along(c(x, 1))"), "SELECT user_id, i::INTEGER AS idx, i AS value FROM (SELECT user_id, unnest(range(1, n + 2)) AS i FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id))"),
    "vector_recycle": (users("sum(x * w)", {"w": [1.0, -1.0, 2.0]}), f"WITH {_E} SELECT user_id, round(sum(x * CASE k % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 2 END), 4) AS value FROM e GROUP BY user_id"),
    "vector_for_fold": (users("{ s <- 0; for (v in x) s <- s * 0.5 + v; s }"), f"WITH {_E} SELECT user_id, round(sum(x * 0.5 ** (n - k)), 4) AS value FROM e GROUP BY user_id"),
    "vector_for_if": (users("{ top <- x[1]; at <- 1; for (i in seq_along(x)) { if (x[i] > top) { top <- x[i]; at <- i } }; top + at }"), f"WITH {_E} SELECT user_id, round(max(x) + arg_max(k, (x, -k)), 4) AS value FROM e GROUP BY user_id"),
    "vector_convolve": (users(CONVOLVE, {"w": [0.25, 0.5, 0.25]}), f"WITH {_E}, m AS (SELECT user_id, k + d AS idx, x * c AS v FROM e, (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 0.25)) t(d, c)) SELECT user_id, idx::INTEGER AS idx, round(sum(v), 4) AS value FROM m GROUP BY user_id, idx"),
    "vector_branches": (users("{ if (length(x) > 60) { y <- x * 2; z <- 1 } else { y <- -x; z <- 2 }; sum(y[c(1, 2)]) + z }"), f"WITH {_LIST} SELECT user_id, round(CASE WHEN len(x) > 60 THEN 2 * (x[1] + x[2]) + 1 ELSE 2 - x[1] - x[2] END, 4) AS value FROM l"),
}
for _name in ("vector_subset", "vector_concat", "vector_rep_each", "vector_rep_times", "vector_rep_length"):
    VECTORS[_name] = (VECTORS[_name][0], VECTORS[_name][1].replace("SELECT user_id, idx, round", "SELECT user_id, idx::INTEGER AS idx, round"))
