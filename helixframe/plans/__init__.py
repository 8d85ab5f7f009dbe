"""Registered queries over the driver tables, each beside the SQL that replays it."""
