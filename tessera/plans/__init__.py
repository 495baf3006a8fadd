"""Query plans: stand-in corpora, the registered queries and their SQL oracle."""

from tessera.plans.registry import ORACLE, QUERIES


def load_all():
    """Import every catalog module so its queries register themselves."""
    from tessera.plans import catalog_text  # noqa: F401
    for mod in ("catalog_order", "catalog_eval", "catalog_graph", "catalog_io", "catalog_ml"):
        try:
            __import__(f"tessera.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"tessera.plans.{mod}":
                raise
    return QUERIES, ORACLE
