"""A job as named tables, each made from others when it is first asked for."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mintweave.session import cut, remove_folder, run_folder, writing_under


class stage:
    """Declares a method as a table; its parameters name the stages it is made from.

    ``stored`` tables are written once to the run's folder, because several later
    stages read them.  A stage whose ``when`` is false for the job is ``None`` and
    asks for nothing.
    """

    def __init__(self, make: Callable | None = None, *, stored: bool = False, when: Callable | None = None):
        self.stored, self.when = stored, when
        if make is not None:
            self(make)

    def __call__(self, make: Callable) -> stage:
        self.make = make
        self.__doc__ = make.__doc__
        self.inputs = tuple(inspect.signature(make).parameters)[1:]
        return self

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, job, owner=None):
        return self if job is None else job.table(self)


class Staged:
    """Base of a staged job.  Use it as a context manager, or call ``close`` when its tables are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = run_folder(spark, name)
        self._tables: dict[str, object] = {}

    def table(self, of: stage):
        if of.name not in self._tables:
            if of.when is not None and not of.when(self):
                self._tables[of.name] = None
            else:
                inputs = {name: getattr(self, name) for name in of.inputs}
                with writing_under(self.folder):
                    made = of.make(self, **inputs)
                    self._tables[of.name] = cut(made, of.name) if of.stored and isinstance(made, DataFrame) else made
        return self._tables[of.name]

    @property
    def made(self) -> set[str]:
        """Names of the stages made so far."""
        return {name for name, table in self._tables.items() if table is not None}

    @classmethod
    def needs(cls, *names: str) -> set[str]:
        """The named stages and all stages they are made from."""
        found: set[str] = set()
        todo = list(names)
        while todo:
            name = todo.pop()
            if name not in found:
                found.add(name)
                todo += getattr(cls, name).inputs
        return found

    def close(self) -> None:
        """Remove the run's folder; the tables made from it can no longer be read."""
        self._tables.clear()
        remove_folder(self.spark, self.folder)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()
