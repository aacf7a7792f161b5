"""deckflow: a Spark-native learning-card feed, search and engagement engine.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for scalar helpers) built from the DataFrame / SQL API, so Catalyst plans,
prunes and pushes down the work; Python runs inside executors only where the
DataFrame API cannot state the semantics (stream state).
"""

__version__ = "0.1.0"
