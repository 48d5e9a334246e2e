"""tunekiln: fine-tuning corpus audit, cleaning, splitting, packing and planning on Spark.

Every operator is a DataFrame transformation built from Spark SQL expressions.
"""

__version__ = "0.1.0"
