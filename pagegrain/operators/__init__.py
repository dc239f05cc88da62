"""DataFrame -> DataFrame operators, lazy and keyed by document, job or query."""
