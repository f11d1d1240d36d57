"""The benchmark tables in the shape of the raw tables, and the SQL they are checked against."""
