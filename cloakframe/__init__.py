"""Privacy-preserving publication of tables as Spark DataFrame operators."""

from cloakframe.definition import Definition, Hierarchy

__all__ = ["Definition", "Hierarchy"]
