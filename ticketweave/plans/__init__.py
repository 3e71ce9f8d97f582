"""Named queries over the given tables, each with its SQL twin."""

from importlib import import_module

MODULES = ["q_rollups", "q_text", "q_logs", "q_windows", "q_joins", "q_sets", "q_evaluation", "q_retrieval", "q_graph", "q_rules", "q_streams"]


def load_all() -> None:
    from importlib.util import find_spec
    for name in MODULES:
        if find_spec(f"ticketweave.plans.{name}"):
            import_module(f"ticketweave.plans.{name}")
