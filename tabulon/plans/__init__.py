"""Named analyses, step chains and the query catalog."""
