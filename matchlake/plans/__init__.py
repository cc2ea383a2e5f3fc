"""Registered queries over the tables at hand, each with the SQL that it is compared with."""

from . import exchange, records  # noqa: F401  (they register their queries beside those of `telemetry`)
