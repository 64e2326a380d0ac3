"""All registered queries: importing this module fills the registry."""

from sentinela.plans import q_rows  # noqa: F401
from sentinela.plans.registry import ORACLE, QUERIES  # noqa: F401

for _m in ("q_aggs", "q_rules", "q_ml", "q_forms"):
    try:
        __import__(f"sentinela.plans.{_m}")
    except ModuleNotFoundError as e:  # module not written yet
        if e.name != f"sentinela.plans.{_m}":
            raise
