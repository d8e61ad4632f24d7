"""Registry and the shared frames the registered queries read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import fixtures as fx
from galley.operators import bibliography, captions, citations, features, headings, zones
from galley.plans import reports
from galley.rules import default_rules
from galley.session import configure, stage

RULES = default_rules()
FINDING = "doc_id:l type:s severity:s status:s paragraph_index:l original_text:s"

_SPARK = {"l": "long", "d": "double", "s": "string", "b": "boolean", "t": "timestamp", "D": "date"}
_SQL = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP", "D": "DATE"}


@dataclass(frozen=True)
class Entry:
    """``spec`` names the result columns and their types, as ``name:l name:s``."""

    spec: str
    run: Callable[[Frames], DataFrame]
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.spec.split()]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = self.run(Frames.of(spark, sf_dir))
        return rows.select(*[F.col(c).cast(_SPARK[k]).alias(c) for c, k in self.columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        from oracle.base import with_ctes

        columns = ", ".join(f'CAST("{c}" AS {_SQL[k]}) AS "{c}"' for c, k in self.columns())
        return with_ctes(f"SELECT {columns} FROM ({self.sql}) AS answer")


ENTRIES: dict[str, Entry] = {}


def query(name: str, spec: str, sql: str | None = None):
    """Register the decorated function, which maps ``Frames`` to a DataFrame."""

    def register(run):
        ENTRIES[name] = Entry(spec, run, sql)
        return run

    return register


class Frames:
    """Source frames, and written intermediate tables shared by several queries."""

    _known: dict[tuple, Frames] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Frames:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def _written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = stage(build(), name)
        return self._tables[name]

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = features.stored(build(), name)
        return self._tables[name]

    def adopt(self, **tables: DataFrame) -> None:
        """Use tables that a caller has written already."""
        self._tables.update(tables)

    def __getattr__(self, name: str):
        source = getattr(fx, name, None)
        if source is None:
            raise AttributeError(name)
        return source(self.spark, self.dir)

    @property
    def features(self) -> DataFrame:
        return self._stored("features", lambda: features.enrich(self.paragraphs))

    @property
    def zoned(self) -> DataFrame:
        return self._stored("zoned", lambda: zones.with_marks(self.features, self.marks))

    @property
    def marks(self) -> DataFrame:
        """The zones of ``zoned`` without the features."""
        if "zoned" in self._tables:
            return self.zoned.select("doc_id", "idx", "in_title", "in_contents", "skip")
        return self._written("marks", lambda: zones.mark_zones(self.features, RULES, onto=self.features.select("doc_id", "idx")))

    @property
    def scored(self) -> DataFrame:
        return self._stored("scored", lambda: headings.score(self.features, RULES, marks=self.marks))

    @property
    def headings(self) -> DataFrame:
        known = "scored" in self._tables
        return self._written("headings", lambda: headings.detect(self.scored) if known else headings.find(self.features, RULES, self.marks))

    @property
    def docs(self) -> DataFrame:
        return fx.table(self.spark, self.dir, "documents").select("doc_id")

    @property
    def found(self) -> reports.Detection:
        return reports.Detection(self.scored, self.headings, self.docs)

    @property
    def bounds(self) -> DataFrame:
        return self._written("bounds", lambda: zones.references_range(self.features, self.headings, RULES))

    @property
    def ranges(self) -> DataFrame:
        return self._written("cited-ranges", lambda: citations.citation_ranges(self.zoned, self.bounds))

    @property
    def mentions(self) -> DataFrame:
        return self._written("mentions", lambda: citations.first_mentions(self.ranges))

    @property
    def listed(self) -> DataFrame:
        return self._written("listed", lambda: bibliography.in_references(self.features, self.bounds))

    @property
    def entries(self) -> DataFrame:
        return self._written("entries", lambda: bibliography.bib_entries(self.listed))

    @property
    def caps(self) -> DataFrame:
        kinds = ("figure", "table", "listing")
        return self._written(
            "caps", lambda: captions.all_captions(self.features, self.headings, RULES, kinds, self.marks)
        )

    @property
    def shown(self) -> DataFrame:
        """Captions of figures and tables."""
        if "caps" in self._tables:
            return self.caps.where("kind <> 'listing'")
        return self._written("shown", lambda: captions.all_captions(self.features, self.headings, RULES, marks=self.marks))

    @property
    def rows_of_tables(self) -> DataFrame:
        return self._written("table-rows", lambda: self.table_rows)
