"""Metric tables and typed rows under SQL names, a session for each reader.

A reader gets a session of its own (:func:`session_of`): views live in it, so
two readers may look at two versions of a store, and one reader's views and
settings are not another's. Views are declarations: a query reads the files of
its version with its filters and columns pushed down to them.

Queries are texts with named parameters (``:period``), which Spark binds as
literals after parsing: a value is never part of the text. Only queries are
taken, no commands, and only over this surface's views: a text that names
anything else, such as a path, is refused before it runs.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolgauge.plans.tables import Store, Tables

#: Views by name: the metric tables, and the typed rows if there are some.
VIEWS = (*[f.name for f in fields(Tables)], "loans")


class QueryError(ValueError):
    """A text is not a query over the views."""


def session_of(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings of SQL, and no views."""
    made = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and made.conf.isModifiable(name):
            made.conf.set(name, value)
    return made


class Surface:
    """The views of one version of a store, of a stored foundation, or of both, in a session of their own."""

    def __init__(self, spark: SparkSession, root: str | None, version: str | None = None, foundation: str | None = None):
        """``root``: a store's, or None for a surface without metric tables. ``foundation``: the folder of a stored foundation, for the view ``loans``."""
        from poolgauge.operators.typed import typed
        from poolgauge.sources import archive

        self.session = session_of(spark)
        self.version, views = version, {}
        if root is not None:
            store = Store(self.session, root)
            self.version = version or store.current()
            tables = store.load(self.version)
            views = {f.name: getattr(tables, f.name) for f in fields(Tables)}
        if foundation is not None:
            # the folder's key, so that a filter on it prunes folders
            stored = archive.read(self.session, foundation)
            views["loans"] = typed(stored.withColumn("period", F.col("reporting_period")))
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        self.views = tuple(views)

    def ask(self, text: str, **parameters) -> DataFrame:
        """The rows of a query; QueryError if the text is none, or reads anything but the views."""
        for name in self._relations(text):
            if name not in self.views:
                raise QueryError(f"{name} is not a view of this surface")
        return self.session.sql(text, args=parameters)

    def _relations(self, text: str) -> set[str]:
        """Names of the relations that a text reads, by Spark's own parser; QueryError if it is a command."""
        parser = self.session._jsparkSession.sessionState().sqlParser()
        try:
            plan = parser.parseQuery(text)
        except Exception as e:
            raise QueryError("not a query") from e
        found: set[str] = set()
        own: set[str] = set()

        def walk(node) -> None:
            kind = node.getClass().getSimpleName()
            if kind == "UnresolvedRelation":
                found.add(node.tableName().lower())
            elif kind == "UnresolvedTableValuedFunction":
                found.add(f"{node.name().mkString('.')}()")
            elif kind in ("UnresolvedWith", "WithCTE"):
                pairs = node.cteRelations()
                for i in range(pairs.size()):
                    own.add(pairs.apply(i)._1().lower())
                    walk(pairs.apply(i)._2())
            for group in (node.children(), node.subqueries()):
                for i in range(group.size()):
                    walk(group.apply(i))

        walk(plan)
        return found - own
