"""DataFrame -> DataFrame operators: search, batch search, hit geometry."""
