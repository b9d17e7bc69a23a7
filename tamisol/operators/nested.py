"""Deeply nested JSON records into related flat tables.

Two passes: the first infers one merged schema over all rows (every path with the kinds of value seen there), the second
walks each record once and yields one row per record and per element of every repeating path, with its own surrogate key, its parent's
key and its ordinals. A row holds all scalars down to the next repeating path, those of objects inside it under dotted names. The
root table and the child tables are typed projections of that one element table, which is made once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamisol.session import materialise

#: A merged schema of more paths than this means, unless a caller says otherwise, that keys are data; such input needs a map, not tables, and is refused.
MAX_PATHS = 20_000

ELEMENTS = "row_key long, path string, ord_path string, ordinal int, parent_path string, parent_ord string, value string"


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """The record in ``text``; a JSON text wrapped in JSON strings counts as its content. None if it isn't valid JSON."""
    while True:
        try:
            found = json.loads(text, parse_constant=_refuse)
        except (ValueError, TypeError, RecursionError):
            return None
        if not isinstance(found, str):
            return found
        text = found  # shorter than what it was wrapped in


def _kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer" if -(2**63) <= v < 2**63 else "string"
    return "number" if isinstance(v, float) else "string"


def _paths(value) -> Iterator[tuple[str, str]]:
    """(path, kind) of everything below ``value``; kinds: array, object, and string, integer, number, boolean for scalars."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            if path:
                yield path, "object"
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in v.items())
        elif isinstance(v, list):
            yield path, "array"
            stack.extend((path, x) for x in v)
        elif v is not None:
            yield path, _kind(v)


def _own(value, path: str, repeating: frozenset[str]):
    """The scalars of an element down to the next repeating path, by dotted names below ``path``; a scalar element is its own value."""
    if not isinstance(value, dict):
        return value
    out, stack = {}, [("", value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                name = f"{at}.{k}" if at else k
                if (f"{path}.{name}" if path else name) not in repeating:
                    stack.append((name, x))
        elif not isinstance(v, list):
            out[at] = v
    return out


def _elements(value, repeating: frozenset[str], full: bool = True) -> Iterator[tuple[str, str, int, str, str, str | None]]:
    """Depth first: path, ord_path, ordinal, parent's path and ord_path, the element's own scalars as JSON (not ``full``: null). The record itself comes first, with the path ''."""
    if value is None:
        return
    text = (lambda x, path: json.dumps(_own(x, path, repeating), ensure_ascii=False)) if full else lambda x, path: None
    yield "", "", 1, "", "", text(value if isinstance(value, dict) else {}, "")
    stack = [("", value, "", "")]
    while stack:
        path, v, up_path, up_ord = stack.pop()
        if path in repeating and path:
            items = [v]
            while any(isinstance(x, list) for x in items):  # an array straight inside an array adds its elements to the same path
                items = [y for x in items for y in (x if isinstance(x, list) else [x])]
            inner = []
            for n, x in enumerate(items, 1):
                if x is None:
                    continue
                at = f"{up_ord}.{n}" if up_ord else str(n)
                yield path, at, n, up_path, up_ord, text(x, path)
                if isinstance(x, dict):
                    inner.extend((f"{path}.{k}", y, path, at) for k, y in x.items() if y is not None)
            stack.extend(reversed(inner))
        elif isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, y, up_path, up_ord) for k, y in reversed(v.items()) if y is not None)
        elif isinstance(v, list):
            stack.extend((path, y, up_path, up_ord) for y in reversed(v) if isinstance(y, dict))


def merged_schema(df: DataFrame, json_col: str, most: int = MAX_PATHS) -> list[tuple[str, str]]:
    """Sorted (path, kind) pairs over all rows of ``df``. Each task sends distinct pairs only, so what reaches the driver is bounded by the schema, not by the rows."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(_paths(parse(text)))
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.string())], ["path", "kind"])

    found = df.select(json_col).filter(F.col(json_col).isNotNull()).mapInArrow(scan, "path string, kind string").distinct()
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} paths: the keys of these records are data")
    return sorted((r.path, r.kind) for r in rows)


def repeating_paths(schema: list[tuple[str, str]]) -> list[str]:
    return sorted({p for p, k in schema if k == "array" and p})


def elements(df: DataFrame, key: str, json_col: str, repeating: Iterable[str], full: bool = True) -> DataFrame:
    """One row for each valid record, with the path '', and for each element of its repeating paths: ELEMENTS.

    ``parent_path`` and ``parent_ord`` name the nearest enclosing element; both are '' for elements right below the record, and ``row_key``
    leads to the record. A value standing alone in a repeating path is its only element; null elements keep their position but
    give no row. Null, empty and invalid texts give no rows; other columns of ``df`` are ignored; repeated rows repeat their elements.
    Not ``full``: without the column value.
    """
    wanted = frozenset(repeating)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        names = ["row_key", "path", "ord_path", "ordinal", "parent_path", "parent_ord", "value"]
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e in _elements(parse(text), wanted, full):
                    for c, x in zip(cols, (k, *e), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(json_col).alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    return rows.mapInArrow(walk, ELEMENTS)


TYPES = {frozenset(("integer",)): T.LongType(), frozenset(("number",)): T.DoubleType(), frozenset(("integer", "number")): T.DoubleType(), frozenset(("boolean",)): T.BooleanType()}


class NestedTables:
    """The flat tables of a column of nested records. ``known``: repeating paths beyond those that occur as arrays in the data."""

    def __init__(self, df: DataFrame, key: str, json_col: str, known: Iterable[str] = ()):
        self.schema = merged_schema(df, json_col)
        self.repeating = sorted({*repeating_paths(self.schema), *known})
        self._df, self._key, self._json, self._made = df, key, json_col, None

    def positions(self) -> DataFrame:
        """(row_key, path, ord_path) of every element of a repeating path, without its content."""
        return elements(self._df, self._key, self._json, self.repeating, full=False).filter("path <> ''").select("row_key", "path", "ord_path")

    def nodes(self) -> DataFrame:
        """All tables in one, with surrogate keys: ``node_key`` of the record or element and ``parent_key`` of its parent (null for records)."""
        rows = elements(self._df, self._key, self._json, self.repeating)
        node = lambda p, o: F.xxhash64("row_key", p, o)
        return rows.withColumns({"node_key": node(F.col("path"), F.col("ord_path")), "parent_key": F.when(F.col("path") != "", node(F.col("parent_path"), F.col("parent_ord")))})

    def elements(self) -> DataFrame:
        """All child tables in one."""
        return self.nodes().filter("path <> ''")

    def _stored(self) -> DataFrame:
        """``nodes`` written once, for all tables."""
        if self._made is None:
            self._made = materialise(self.nodes(), "nodes")
        return self._made

    def fields(self, path: str) -> dict[str, T.DataType]:
        """The scalar columns of the table of ``path`` with their types: dotted names below it, down to the next repeating path. Fields of mixed kinds are text."""
        kinds: dict[str, set[str]] = {}
        for p, k in self.schema:
            inside = p if not path else p[len(path) + 1 :] if p.startswith(path + ".") else ""
            if inside and k not in ("array", "object"):
                steps = inside.split(".")
                above = (".".join([*([path] if path else []), *steps[:n]]) for n in range(1, len(steps) + 1))
                if not any(a in self.repeating for a in above):
                    kinds.setdefault(inside, set()).add(k)
        return {name: TYPES.get(frozenset(k), T.StringType()) for name, k in sorted(kinds.items())}

    def table(self, path: str = "") -> DataFrame:
        """The child table of one repeating path, or with '' the root table: keys, ordinals and a typed column for each of ``fields``; ``value`` for scalar elements.

        Columns whose names are taken by keys are called field_<name>.
        """
        fields = self.fields(path)
        scalar = {k for p, k in self.schema if p == path and path} - {"array", "object"}
        rows = self._stored().filter(F.col("path") == path)
        if fields:
            rows = rows.withColumn("__f", F.from_json("value", T.StructType([T.StructField(n, k) for n, k in fields.items()])))
        taken = {"row_key", "node_key", "parent_key", "ordinal", "ord_path", "value"}
        cols = [F.col("__f").getField(n).alias(f"field_{n}" if n in taken else n) for n in fields]
        one = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
        plain = [F.when(~F.col("value").startswith("{"), one.cast(TYPES.get(frozenset(scalar), T.StringType()))).alias("value")] if scalar or path and not fields else []
        return rows.select("row_key", "node_key", *(["parent_key", "ordinal", "ord_path"] if path else []), *cols, *plain)
