"""Site-structure analytics over page tables, expressed as DataFrame and SQL queries."""

__version__ = "0.1.0"
