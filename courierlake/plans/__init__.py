"""The registered queries: operators applied to the driver's tables, with the SQL that gives the same rows."""
