"""All queries of the core library."""

from __future__ import annotations

from graphloom.plans import feeds, lookups, more, patterns, recall, walks, writes

FLAGSHIP = "flagship"
QUERIES = {**lookups.QUERIES, **patterns.QUERIES, **walks.QUERIES, **writes.QUERIES, **recall.QUERIES, **more.QUERIES, **feeds.QUERIES}
SQL = {**lookups.SQL, **patterns.SQL, **walks.SQL, **writes.SQL, **recall.SQL, **more.SQL, **feeds.SQL}
