"""The registered queries on the test tables, and their SQL counterparts."""
