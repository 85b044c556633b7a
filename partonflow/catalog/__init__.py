"""Registered queries and, next to each, the SQL that must give the same rows."""


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for module in ("scans", "elements", "combinations", "histograms", "kinematics", "benchmarks", "analyses", "streams"):
        import_module(f"partonflow.catalog.{module}")
