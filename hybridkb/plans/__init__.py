"""Query plans wired to the test tables, each with an equivalent SQL text."""
