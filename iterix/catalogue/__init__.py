"""One query for each operator of the statistics engine, and the SQL that gives the same rows."""

from iterix.catalogue.groups import GROUPS
from iterix.catalogue.vectors import VECTORS
from iterix.catalogue.windows import WINDOWS

_ALL = GROUPS | VECTORS | WINDOWS
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items()}
