"""From a request to rows: which tables, and how they are put together."""
