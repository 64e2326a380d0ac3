"""Sources and sinks."""

from sentinela.sources.binding import occurrences, order_incidents  # noqa: F401
