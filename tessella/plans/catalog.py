"""Every query of the library by name, and the SQL it is held against."""

from __future__ import annotations

from tessella.plans import pointwise, signals, streams

QUERIES: dict = {**pointwise.QUERIES, **signals.QUERIES, **streams.QUERIES}
ORACLE_SQL: dict = {**pointwise.ORACLE_SQL, **signals.ORACLE_SQL, **streams.ORACLE_SQL}
