"""cardtrail: trace money transfers through a card-transaction history on Spark.

Everything is a PySpark DataFrame transformation: card lists and frontiers stay
distributed (semi / existence joins, aggregations, a checkpointed iteration),
nothing but per-round counts reaches the driver.
"""

__version__ = "0.1.0"
