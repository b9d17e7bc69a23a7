"""Records that are the same but for their layout, collapsed by Merkle-style hashing.

A record is a tree: leaves are normalised, the digest of a node is the hash of its children's digests, sorted where their order
carries no meaning. Records with the same root digest form a group; each copy is then compared with the kept record node by node.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamisol.operators.nested import parse
from tamisol.operators.skew import join_groups
from tamisol.session import materialise

# Letters whose upper-case form is that of another letter although they are not its other case.
_KEPT = str.maketrans({c: f"{ord(c):x}" for c in "ſµﬀﬁﬂﬃﬄﬅﬆ"})
_DOTTED = re.compile(r"(?<![^\W_])([^\W\d_])\.(?=[^\W\d_](?![^\W_]))")


def _separator(c: str) -> bool:
    return c in " \t\n\r\v\f"


def words(text: str | None) -> list[str]:
    """Upper-case words without layout: ASCII white space and punctuation separate, dotted abbreviations are one word, and so are their undotted forms."""
    if not text:
        return []
    t = _DOTTED.sub(r"\1", text)
    t = "".join(" " if _separator(c) or _punctuation(c) else c for c in t)
    return [w.translate(_KEPT).upper().replace("I\u0307", "\u0130") for w in t.split(" ") if w]


_PUNCTUATION: dict[str, bool] = {}


def _punctuation(c: str) -> bool:
    p = _PUNCTUATION.get(c)
    if p is None:
        p = _PUNCTUATION[c] = unicodedata.category(c)[0] == "P"
    return p


class Unordered(list):
    """Children whose order carries no meaning."""


def tree(record: dict, loose: frozenset[str] = frozenset()) -> list:
    """The record as nested lists: leaves are strings, Unordered nodes ignore order, objects are Unordered nodes of (key, value). Fields in
    ``loose`` are normalised like names; 'raw_data' there normalises the texts inside the record."""
    raw = record.get("raw_data")
    value = parse(raw) if raw else None
    return [
        *(Unordered(words(record.get(k))) if k in loose else record.get(k) or "" for k in ("source", "dob", "nationality", "entity_type", "program", "listed_on")),
        Unordered(words(record.get("full_name"))),
        Unordered([*words(record.get("last_name")), *words(record.get("first_name"))]),
        _json(value, "raw_data" in loose) if value is not None else [raw or ""],
    ]


def _json(v, loose: bool = False):
    if isinstance(v, dict):
        return Unordered([[k, _json(x, loose)] for k, x in v.items()])
    if isinstance(v, list):
        return [_json(x, loose) for x in v]
    if loose and isinstance(v, str):
        return Unordered(words(v))
    return v if isinstance(v, str) else f"{v!r}"


def digest(node) -> bytes:
    """Bottom-up: leaf, ordered and unordered nodes hash under different marks."""
    h = blake2b(digest_size=16)
    if isinstance(node, str):
        h.update(b"l" + node.encode("utf-8", "surrogatepass"))
    else:
        children = [digest(c) for c in node]
        if isinstance(node, Unordered):
            children.sort()
        h.update(b"u" if isinstance(node, Unordered) else b"o")
        for c in children:
            h.update(c)
    return h.digest()


def _canonical(node):
    """The tree with unordered children in a fixed order, found by comparing structures instead of hashes."""
    if isinstance(node, str):
        return node
    children = [_canonical(c) for c in node]
    return sorted(children, key=repr) if isinstance(node, Unordered) else children


def same(a: dict, b: dict, loose: frozenset[str] = frozenset()) -> bool:
    return _canonical(tree(a, loose)) == _canonical(tree(b, loose))


FIELDS = ["source", "dob", "nationality", "entity_type", "program", "listed_on", "full_name", "last_name", "first_name", "raw_data"]


def digests(df: DataFrame, key: str = "id", loose: frozenset[str] = frozenset()) -> DataFrame:
    """(key, digest) of every record."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(i + 1).to_pylist() for i, c in enumerate(FIELDS)}
            out = [digest(tree({c: cols[c][i] for c in FIELDS}, loose)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "digest"])

    return df.select(F.col(key).cast("long").alias(key), *FIELDS).mapInArrow(scan, f"{key} long, digest binary")


def copies(df: DataFrame, key: str = "id", loose: frozenset[str] = frozenset()) -> DataFrame:
    """(kept_id, copy_id): each record that repeats another one in a different layout, with the smallest key of its group. Names are
    normalised; ``loose``: other fields that are, too.

    The grouping aggregates (smallest key, count) before the shuffle, so a group of any size moves one row per task. Null equals ''; records
    without a name are compared by their other fields; an invalid raw record is compared as text; a row whose key repeats is the same record.
    """
    each = materialise(digests(df, key, loose), "digests")
    groups = each.groupBy("digest").agg(F.min(key).alias("kept_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialise(groups, "groups")
    pairs = materialise(join_groups(each, groups, "digest", "n").filter(F.col(key) != F.col("kept_id")).select("kept_id", F.col(key).alias("copy_id"), "n").distinct(), "pairs")
    return confirmed(df, pairs, key, loose)


def confirmed(df: DataFrame, pairs: DataFrame, key: str, loose: frozenset[str] = frozenset()) -> DataFrame:
    """The pairs whose records are equal node by node. A kept record meets its copies by join_groups, so hot groups don't gather in one task."""
    record = F.struct(*FIELDS)
    source = df.select(F.col(key).cast("long").alias(key), *FIELDS).dropDuplicates([key])
    kept = source.join(pairs.select(F.col("kept_id").alias(key), "n").distinct(), key).select(F.col(key).alias("kept_id"), "n", record.alias("kept"))
    copy = source.join(pairs.select("kept_id", F.col("copy_id").alias(key)), key).select("kept_id", F.col(key).alias("copy_id"), record.alias("copy"))
    both = join_groups(materialise(copy, "copies"), materialise(kept, "kept"), "kept_id", "n").select("kept_id", "copy_id", "kept", "copy")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            equal = [same(x, y, loose) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = [i for i, e in enumerate(equal) if e]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["kept_id", "copy_id"])

    return both.mapInArrow(compare, "kept_id long, copy_id long")


def collapsed(df: DataFrame, key: str = "id", loose: frozenset[str] = frozenset()) -> DataFrame:
    """(id, copies): one record per entry with the number of records it stands for, itself included."""
    pairs = copies(df, key, loose)
    gone = materialise(pairs, "gone")
    counts = gone.groupBy(F.col("kept_id").alias(key)).agg((F.count(F.lit(1)) + 1).alias("copies"))
    kept = df.select(F.col(key).cast("long").alias(key)).distinct().join(gone.select(F.col("copy_id").alias(key)), key, "left_anti")
    return kept.join(counts, key, "left").select(key, F.coalesce("copies", F.lit(1)).alias("copies"))
