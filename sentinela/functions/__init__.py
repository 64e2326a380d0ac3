"""Column-level functions (JVM-side expressions, no Python UDFs)."""

from sentinela.functions.scalar import *  # noqa: F401,F403
