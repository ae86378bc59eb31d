"""Registered queries over the driver tables, each with the SQL its result must equal."""
