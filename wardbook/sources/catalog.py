"""Where the reports get their source tables from.

A ``Tables`` object hands out one DataFrame per source table, with the declared
columns and types of :mod:`wardbook.sources.schemas`.  Nothing is read before a
report asks for it, and only the columns a report uses are scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from wardbook.sources.schemas import FACTS, OWNERS, SCHEMAS

FETCH_ROWS = 10_000
"""Rows a database sends at once."""


def declared_columns(table: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a source table."""
    return [tuple(column.split(" ", 1)) for column in SCHEMAS[table].split(", ")]


def conform(
    frame: DataFrame,
    table: str,
    empty_as_null: bool = False,
    extra: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """Project a frame to the declared columns and types.

    A cast to the type a column already has is dropped by the optimizer, so
    filters still reach the scan.  ``empty_as_null`` turns empty texts into
    NULL, as the source database does by itself; it is off by default because
    it hides text columns from filter pushdown and files exported from that
    database hold no empty texts. ``extra`` columns are those of a layout of
    our own, kept beside the declared ones.
    """
    projected = []
    for name, kind in [*declared_columns(table), *extra]:
        text = f"nullif(`{name}`, '')" if empty_as_null and kind == "string" else f"`{name}`"
        projected.append(f"cast({text} as {kind}) as `{name}`")
    return frame.selectExpr(*projected)


def number_ranges(column: str, low: int | None, high: int | None, parts: int) -> list[str]:
    """Conditions that share a table out by a whole-number column: every row meets one and only one.

    The outer ranges are open and NULLs have a condition of their own, so rows
    that came after the bounds were read are not missed either.
    """
    if parts < 1:
        raise ValueError(f"a table is read in one part at least, got {parts}")
    width = 1 if low is None or high is None else -(-(high - low + 1) // parts)
    cuts = [] if low is None or high is None else list(range(low + width, high + 1, width))
    if not cuts:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {cuts[0]}", *inner, f"{column} >= {cuts[-1]}", f"{column} IS NULL"]


def bounds_query(relation: str, column: str) -> str:
    """One row: the smallest and the largest value of a column."""
    return f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {relation}) bounds"


class Tables:
    """Lazy catalog of source tables, reached as attributes or by name.

    Set ``numbers_follow_time`` to True on a catalog whose document and
    admission numbers are given out in sequence.  Reports on a window of time
    then bound the numbers they look for before they scan lines and orders,
    which pays on large tables.  It never changes a result, whatever the numbers are like.

    Set ``count_by_bits`` to True where a group of a revenue report has many of the invoice
    numbers that lie close together (500 in 32,768 or more): these are then counted as sets of bits.
    """

    numbers_follow_time = False
    count_by_bits = False

    def __init__(
        self,
        load: Callable[[str], DataFrame],
        names: Iterable[str] = SCHEMAS,
        empty_as_null: bool = False,
        extra: Mapping[str, Iterable[tuple[str, str]]] | None = None,
    ):
        self._load = load
        self._extra = dict(extra or {})
        self._names = frozenset(names)
        self._empty_as_null = empty_as_null
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(f"no source table named {name!r}")
        if name not in self._frames:
            self._frames[name] = conform(
                self._load(name), name, self._empty_as_null, self._extra.get(name, ())
            )
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(f"no source table named {name!r}")
        return self[name]

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame], empty_as_null: bool = False) -> Tables:
        """Catalog over DataFrames the caller already has."""
        return cls(frames.__getitem__, frames, empty_as_null)

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        root: str,
        fmt: str = "parquet",
        empty_as_null: bool = False,
        **options: str,
    ) -> Tables:
        """Catalog over one folder of files per table, ``root/<table>``."""

        def load(name: str) -> DataFrame:
            reader = spark.read.format(fmt).options(**options)
            if fmt in ("csv", "json"):
                reader = reader.schema(SCHEMAS[name])
            return reader.load(f"{root}/{name}")

        return cls(load, empty_as_null=empty_as_null)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> Tables:
        """Catalog over metastore tables, all in one database or one database per owner."""
        return cls(lambda name: spark.table(f"{database or OWNERS[name]}.{name}"))

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: Mapping[str, str],
        splits: Mapping[str, Mapping[str, str]] | None = None,
        shares: Mapping[str, tuple[str, int]] | None = None,
        relations: Mapping[str, str] | None = None,
    ) -> Tables:
        """Catalog over the live database, ``<owner>.<table>`` through JDBC.

        ``relations`` replaces the default relation of a table, for instance by
        a subquery that calls the database's own item label function.

        ``splits`` gives, per table, the ``partitionColumn``, ``lowerBound``,
        ``upperBound`` and ``numPartitions`` of a parallel read.  ``shares`` gives
        a whole-number column and a number of parts instead: one aggregate query
        finds the bounds when a report first asks for the table, and NULLs are a
        part of their own (``number_ranges``).  A table without an entry is read
        through one connection; for a table that grows with the hospital's work
        (``FACTS``) that is a ``ValueError``, raised when a report asks for it.  Columns are read with their declared types, so
        no cast stands between a filter and the database.
        """

        def load(name: str) -> DataFrame:
            if name in FACTS and name not in {**(splits or {}), **(shares or {})}:
                raise ValueError(f"{name} is too large for one connection: give it an entry in splits or shares")
            relation = (relations or {}).get(name, f"{OWNERS[name]}.{name}")

            def reading(of: str, **more: str) -> DataFrameReader:
                options = {"url": url, "fetchsize": str(FETCH_ROWS), "dbtable": of, **properties, **more}
                return spark.read.format("jdbc").options(**options)

            declared = {"customSchema": SCHEMAS[name], "preferTimestampNTZ": "true"}
            if shares and name in shares:
                column, parts = shares[name]
                bounds = reading(bounds_query(relation, column)).load().first()
                low, high = (None if value is None else int(value) for value in bounds)
                conditions = number_ranges(column, low, high, parts)
                connection = {**properties, **declared, "fetchsize": str(FETCH_ROWS)}
                return spark.read.jdbc(url, relation, predicates=conditions, properties=connection)
            return reading(relation, **declared, **(splits or {}).get(name, {})).load()

        return cls(load)
