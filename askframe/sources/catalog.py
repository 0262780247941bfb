"""Schema catalogs: tables with typed and aliased columns, keys, and the DataFrames behind them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DECIMAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def type_tag(name: str, kind: T.DataType) -> str:
    """integer, decimal, datetime, string or vector. A string column counts as a date by its name."""
    if isinstance(kind, _INTEGER):
        return "integer"
    if isinstance(kind, _DECIMAL):
        return "decimal"
    if isinstance(kind, _TIME):
        return "datetime"
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (*_DECIMAL, *_INTEGER)):
        return "vector"
    if isinstance(kind, T.StringType) and (name.endswith("_date") or name in ("date", "created_at")):
        return "datetime"
    return "string"


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    aliases: tuple[str, ...] = ()
    #: Equality ignores commas and doubled spaces, as for postal addresses.
    loose: bool = False


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    referenced_table: str
    referenced_column: str


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: Mapping[str, ColumnInfo]
    aliases: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    def typed(self, *tags: str) -> list[ColumnInfo]:
        return [c for c in self.columns.values() if c.type in tags]


def _aliases(name: str, given: Iterable[str] = ()) -> tuple[str, ...]:
    return tuple(dict.fromkeys([name, name.replace("_", " "), *given]))


def _key(alias: str) -> str:
    return alias.strip().lower()


@dataclass
class Catalog:
    """Tables by name, and lookups by alias. ``frames`` gives the DataFrame of a table when it is asked for."""

    tables: dict[str, TableInfo] = field(default_factory=dict)
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._by_alias: dict[str, str] = {}
        self._columns: dict[str, list[tuple[str, str]]] = {}
        for table in self.tables.values():
            for alias in table.aliases:
                self._by_alias[_key(alias)] = table.name
            for column in table.columns.values():
                for alias in column.aliases:
                    places = self._columns.setdefault(_key(alias), [])
                    if (table.name, column.name) not in places:
                        places.append((table.name, column.name))

    # lookups

    def table_of(self, phrase: str) -> str | None:
        """The table of an alias, whatever its case."""
        return self._by_alias.get(_key(phrase))

    def columns_of(self, phrase: str, table: str | None = None) -> list[tuple[str, str]]:
        """Tables and columns of a column alias, all tables' or one's."""
        return [x for x in self._columns.get(_key(phrase), []) if table is None or x[0] == table]

    def column(self, table: str, name: str) -> ColumnInfo | None:
        info = self.tables.get(table)
        return info.columns.get(name) if info else None

    def frame(self, table: str) -> DataFrame:
        return self.frames[table]()

    @property
    def foreign_keys(self) -> list[ForeignKey]:
        return [k for t in self.tables.values() for k in t.foreign_keys]

    # construction

    @classmethod
    def from_dict(cls, tables: Mapping[str, Any], frames: Mapping[str, DataFrame] | None = None) -> Catalog:
        """From {table: {aliases, columns: {name: {type, aliases}}, primary_key, foreign_keys}}."""
        made = {}
        for name, spec in tables.items():
            columns = {
                c: ColumnInfo(c, str(v.get("type", "string")), _aliases(c, v.get("aliases", ())), bool(v.get("loose", "address" in c)))
                for c, v in spec.get("columns", {}).items()
            }
            keys = tuple(ForeignKey(name, k["column"], k["referenced_table"], k["referenced_column"]) for k in spec.get("foreign_keys", ()))
            made[name] = TableInfo(name, columns, _aliases(name, spec.get("aliases", ())), tuple(spec.get("primary_key", ())), keys)
        return cls(made, {k: (lambda df=v: df) for k, v in (frames or {}).items()})

    @classmethod
    def from_json(cls, path: str | Path, frames: Mapping[str, DataFrame] | None = None) -> Catalog:
        return cls.from_dict(json.loads(Path(path).read_text("utf-8")), frames)

    @classmethod
    def from_frames(
        cls,
        frames: Mapping[str, DataFrame],
        table_aliases: Mapping[str, Iterable[str]] | None = None,
        column_aliases: Mapping[str, Mapping[str, Iterable[str]]] | None = None,
        primary_keys: Mapping[str, Iterable[str]] | None = None,
        foreign_keys: Iterable[ForeignKey] = (),
        loose: Iterable[tuple[str, str]] = (),
    ) -> Catalog:
        """By introspection of DataFrames. Files hold no keys and aliases, so those are given."""
        keys, soft, made = list(foreign_keys), set(loose), {}
        for name, df in frames.items():
            given = (column_aliases or {}).get(name, {})
            columns = {
                f.name: ColumnInfo(f.name, type_tag(f.name, f.dataType), _aliases(f.name, given.get(f.name, ())), "address" in f.name or (name, f.name) in soft)
                for f in df.schema.fields
            }
            own = tuple(k for k in keys if k.table == name)
            made[name] = TableInfo(name, columns, _aliases(name, (table_aliases or {}).get(name, ())), tuple((primary_keys or {}).get(name, ())), own)
        return cls(made, {k: (lambda df=v: df) for k, v in frames.items()})

    @classmethod
    def from_session(cls, spark: SparkSession, database: str | None = None, **given: Any) -> Catalog:
        """By introspection of the tables and views that a session knows."""
        names = [t.name for t in spark.catalog.listTables(database)]
        return cls.from_frames({n: spark.table(n) for n in names}, **given)

    def to_dict(self) -> dict[str, Any]:
        return {
            t.name: {
                "aliases": list(t.aliases),
                "columns": {c.name: {"type": c.type, "aliases": list(c.aliases)} for c in t.columns.values()},
                "primary_key": list(t.primary_key),
                "foreign_keys": [vars(k) for k in t.foreign_keys],
            }
            for t in self.tables.values()
        }
