"""civiclens: incident, event and document analytics as PySpark DataFrame operators.

Sub-packages
------------
functions   Column expressions (Catalyst, codegen-friendly) shared by the operators.
sources     Readers for landed files (CSV, JSON, GeoJSON, HTML pages) and sinks.
operators   Relational operators: joins, profiles, hot-spots, audits, risk, rates.
plans       Reusable plan shapes (skew-safe scans, size-checked broadcast) and the
            bindings of every operator to the driver tables.
streaming   Structured Streaming forms of the batch operators.
"""

__version__ = "0.1.0"
