"""Plan helpers: table access, written intermediate tables, session defaults."""
