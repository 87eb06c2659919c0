"""specloom: tabular-document analytics on Spark.

Positioned text tokens of scanned specification sheets become clean, reviewable rows: range joins put
tokens into cells, aggregations choose readings, expressions normalise text, windows repair and classify
rows. Everything on the row path is a Catalyst-visible expression.
"""

__version__ = "0.1.0"
