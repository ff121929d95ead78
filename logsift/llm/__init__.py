"""Operators for preparing training corpora, each a Spark job over whole tables.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
only when the package is present."""
