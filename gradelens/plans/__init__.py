"""Named reports and the query catalog over the test tables."""
