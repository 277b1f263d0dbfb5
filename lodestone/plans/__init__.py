"""Named queries over the test tables, with SQL for the same rows."""
