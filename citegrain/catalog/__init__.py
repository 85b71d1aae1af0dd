"""The registered queries: operators wired to the given tables, each with its plain SQL."""
