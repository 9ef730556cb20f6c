"""Simplexa: Spark-native dimensionality reduction and nearest-neighbour analytics.

Every operator is a ``DataFrame -> DataFrame`` function over point tables
``(id, features)``, edge tables ``(i, j, ...)`` and embedding tables
``(id, embedding)``.
"""

__version__ = "0.1.0"
