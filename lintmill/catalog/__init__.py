"""Named queries over the test tables, and SQL to check them with."""
