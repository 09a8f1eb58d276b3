"""Named queries over the tables of a folder, and the SQL that gives the same rows."""
