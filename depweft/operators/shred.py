"""Deeply nested records shredded into columns with repetition and definition levels, and flat tables made from them.

A path is written with its repeated steps marked by ``*``: ``steps.step*.properties.property*.value``. Every scalar leaf
is a column of its own, shredded into three parallel sequences: the repetition level (which repeated step starts anew; 0
starts a record), the definition level (how much of the path is there) and the value. All leaves are shredded in one
walk of a document, which is then dropped. A flat table per repeated ancestor is rebuilt from the level sequences of the
leaves below it alone, by running counts, without the documents: each row keeps its record, the places of all its
repeated ancestors and its own, and a column for each leaf.

A repeated step has two definition levels, one for the slot and one for an object in it, so that null or scalar
entries keep their place without becoming rows. A single object where a list is expected is a list of one.

Documents may be JSON texts or nested columns; the latter are walked as they are.

Defined results: a null, blank, truncated or otherwise unreadable document, and one without any record object, give no
rows; a byte order mark, a document encoded twice as a JSON string and a wrapper object or list around the records are
unwrapped; missing or null leaves give null values; leaves that are not text are written as JSON; repeated rows give
repeated rows. Documents are handled one at a time, and what was shredded leaves a task every ``FLUSH`` entries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column as SqlColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.runtime import map_batches

#: Level entries held before they leave a task.
FLUSH = 200_000


@dataclass(frozen=True)
class Leaf:
    """One leaf column: the steps to its object, ``*`` for repeated ones, and the field in it."""

    path: str
    field: str

    @property
    def steps(self) -> list[tuple[str, bool]]:
        return [(s.rstrip("*"), s.endswith("*")) for s in self.path.split(".")] if self.path else []

    @property
    def repeats(self) -> int:
        return sum(r for _, r in self.steps)

    @property
    def ancestor(self) -> str:
        """The path of the innermost repeated step."""
        parts = self.path.split(".")
        return ".".join(parts[: max(i for i, p in enumerate(parts) if p.endswith("*")) + 1])

    def slot_level(self, depth: int) -> int:
        """Definition level at which the ``depth``-th repeated step (from 1) has a slot; one more: an object."""
        level = seen = 0
        for _, repeated in self.steps:
            level += 1 + repeated
            seen += repeated
            if repeated and seen == depth:
                return level - 1
        raise ValueError(f"{self.path} has no {depth} repeated steps")


@dataclass(frozen=True)
class Flat:
    """The table of one repeated ancestor: its name, its path, and (column, steps below it, field) for each leaf."""

    name: str
    path: str
    columns: tuple[tuple[str, str, str], ...]

    @property
    def leaves(self) -> list[Leaf]:
        return [Leaf(f"{self.path}.{below}" if below else self.path, field) for _, below, field in self.columns]


def read_records(text: str | None, wrapper: str | None = None) -> list[dict]:
    """The record objects in a document; empty if it is unusable."""
    value: object = text
    for _ in range(3):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value.lstrip("\ufeff \t\r\n"))
        except (ValueError, RecursionError):
            return []
    if isinstance(value, dict) and wrapper and wrapper in value:
        value = value[wrapper]
    found = value if isinstance(value, list) else [value]
    return [x for x in found if isinstance(x, dict)]


class Column:
    """The level sequences of one leaf."""

    def __init__(self, leaf: Leaf) -> None:
        self.leaf = leaf
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.values: list = []

    def levels(self) -> tuple[np.ndarray, np.ndarray, list]:
        return np.array(self.reps, dtype=np.int32), np.array(self.defs, dtype=np.int32), self.values


class Shredder:
    """Shreds records into all leaf columns, each record in one walk over the tree of their steps."""

    def __init__(self, leaves: list[Leaf]) -> None:
        self.columns = [Column(x) for x in leaves]
        self.tree: dict = {"fields": [], "below": {}}
        for c in self.columns:
            node = self.tree
            for step in c.leaf.steps:
                node = node["below"].setdefault(step, {"fields": [], "below": {}})
            node["fields"].append(c)
        self.entries = 0

    def _absent(self, node: dict, rep: int, level: int) -> None:
        for c in node["fields"]:
            c.reps.append(rep)
            c.defs.append(level)
            c.values.append(None)
            self.entries += 1
        for below in node["below"].values():
            self._absent(below, rep, level)

    def _walk(self, node: dict, value: dict, rep: int, level: int, depth: int) -> None:
        for c in node["fields"]:
            found = value.get(c.leaf.field)
            c.reps.append(rep)
            c.defs.append(level + (found is not None))
            c.values.append(found)
            self.entries += 1
        for (key, repeated), below in node["below"].items():
            inner = value.get(key)
            if inner is None:
                self._absent(below, rep, level)
            elif not repeated:
                if isinstance(inner, dict):
                    self._walk(below, inner, rep, level + 1, depth)
                else:
                    self._absent(below, rep, level)
            else:
                slots = inner if isinstance(inner, list) else [inner]
                if not slots:
                    self._absent(below, rep, level)
                for n, slot in enumerate(slots):
                    r = rep if n == 0 else depth + 1
                    if isinstance(slot, dict):
                        self._walk(below, slot, r, level + 2, depth + 1)
                    else:
                        self._absent(below, r, level + 1)

    def add(self, record: dict) -> None:
        self._walk(self.tree, record, 0, 0, 0)


def shred(records: list[dict], leaf: Leaf) -> tuple[np.ndarray, np.ndarray, list]:
    """Level columns of one leaf over several records: repetition levels, definition levels, values."""
    shredder = Shredder([leaf])
    for record in records:
        shredder.add(record)
    return shredder.columns[0].levels()


def places(reps: np.ndarray, depth: int) -> np.ndarray:
    """The place (from 1) of each entry's ``depth``-th repeated step among its siblings."""
    at = np.arange(len(reps))
    begun = np.cumsum(reps == depth)
    start = np.maximum.accumulate(np.where(reps < depth, at, 0)) if len(reps) else at
    return begun - begun[start] + 1


def rebuild(leaf: Leaf, reps: np.ndarray, defs: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of the innermost repeated step from the level columns: entry, record, parent_pos, pos and all places.

    ``pos`` counts within the parent, ``parent_pos`` within the grandparent (0 if the parent is the record); ``place1``
    to ``placeN`` are the places of all repeated steps from the outermost.
    """
    n, inner = len(reps), leaf.repeats
    kept = defs > leaf.slot_level(inner)
    out = {f"place{d}": places(reps, d)[kept] for d in range(1, inner + 1)}
    parent = out[f"place{inner - 1}"] if inner > 1 else np.zeros(int(kept.sum()), dtype=np.int64)
    return {"entry": np.arange(n)[kept], "record": (np.cumsum(reps == 0) - 1)[kept], "parent_pos": parent, "pos": out[f"place{inner}"], **out}


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_LEVELS = "row_key bigint, path string, entry bigint, rep int, def int, value string"


def _shredded(batches: Iterator[pa.RecordBatch], leaves: list[Leaf], wrapper: str | None, field: str | None) -> Iterator[tuple[np.ndarray, Shredder]]:
    """Keys of the records and their shredded columns, portion by portion; ``field``: the column's name as first step."""
    keys, shredder = [], Shredder(leaves)
    for batch in batches:
        for key, document in zip(batch.column(0), batch.column(1)):
            value = document.as_py()
            for record in [{field: value}] if field else read_records(value, wrapper):
                shredder.add(record)
                keys.append(key.as_py())
            if shredder.entries >= FLUSH:
                yield np.array(keys, dtype=object), shredder
                keys, shredder = [], Shredder(leaves)
    if keys:
        yield np.array(keys, dtype=object), shredder


def _documents(df: DataFrame, key: str, document: str) -> tuple[DataFrame, str | None]:
    kind = dict(df.select(F.col(document).alias("d")).dtypes)["d"]
    nested = kind.startswith("struct")
    value = F.col(document) if nested else F.col(document).cast("string")
    return df.select(F.col(key).cast("bigint").alias("row_key"), value.alias("document")), document if nested else None


def flat_rows(df: DataFrame, key: str, document: str, tables: list[Flat], wrapper: str | None = None) -> DataFrame:
    """Rows of all flat tables: ``row_key, path, parent_pos, pos, places, leaves`` (leaves: value by column name).

    The documents are walked once for all tables; ``flat_table`` makes the typed frame of one.
    """
    rows, field = _documents(df, key, document)
    leaves = [x for t in tables for x in t.leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, shredder in _shredded(batches, leaves, wrapper, field):
            first = 0
            for t in tables:
                columns = shredder.columns[first : first + len(t.columns)]
                first += len(columns)
                reps, defs, _ = columns[0].levels()
                made = rebuild(columns[0].leaf, reps, defs)
                size = len(made["pos"])
                if not size:
                    continue
                depth = columns[0].leaf.repeats
                steps = np.stack([made[f"place{d}"] for d in range(1, depth + 1)], axis=1)
                entries = made["entry"].tolist()
                values = [[_text(c.values[i]) for i in entries] for c in columns]
                names = [name for name, _, _ in t.columns]
                leaf_map = pa.MapArray.from_arrays(
                    pa.array(np.arange(size + 1) * len(names), pa.int32()), pa.array(names * size, pa.string()), pa.array([v for row in zip(*values) for v in row], pa.string())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[made["record"]], pa.int64()),
                        pa.array([t.name] * size, pa.string()),
                        pa.array(made["parent_pos"], pa.int64()),
                        pa.array(made["pos"], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * depth, pa.int32()), pa.array(steps.ravel(), pa.int64())),
                        leaf_map,
                    ],
                    names=["row_key", "path", "parent_pos", "pos", "places", "leaves"],
                )

    return map_batches(rows, run, "row_key bigint, path string, parent_pos bigint, pos bigint, places array<bigint>, leaves map<string,string>")


def flat_table(rows: DataFrame, table: Flat) -> DataFrame:
    """One flat table of ``flat_rows``: ``row_key, parent_pos, pos`` and a column for each leaf."""
    return rows.filter(F.col("path") == table.name).select("row_key", "parent_pos", "pos", *[F.col("leaves")[name].alias(name) for name, _, _ in table.columns])


def level_columns(df: DataFrame, key: str, document: str, leaves: list[Leaf], wrapper: str | None = None) -> DataFrame:
    """The shredded columns themselves: ``row_key, path, entry, rep, def, value``; entry counts within the record."""
    rows, field = _documents(df, key, document)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, shredder in _shredded(batches, leaves, wrapper, field):
            for column in shredder.columns:
                reps, defs, values = column.levels()
                at = np.arange(len(reps))
                starts = np.maximum.accumulate(np.where(reps == 0, at, 0)) if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[np.cumsum(reps == 0) - 1] if len(at) else [], pa.int64()),
                        pa.array([f"{column.leaf.path.replace('*', '')}.{column.leaf.field}"] * len(at), pa.string()),
                        pa.array(at - starts, pa.int64()),
                        pa.array(reps, pa.int32()),
                        pa.array(defs, pa.int32()),
                        pa.array([_text(v) for v in values], pa.string()),
                    ],
                    names=["row_key", "path", "entry", "rep", "def", "value"],
                )

    return map_batches(rows, run, _LEVELS)


def record_fields(df: DataFrame, key: str, document: str, fields: dict[str, str], wrapper: str | None = None) -> DataFrame:
    """The records themselves: ``row_key`` and a column for each of ``fields`` (column: field of the record)."""
    rows, field = _documents(df, key, document)
    leaves = [Leaf("", f) for f in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, shredder in _shredded(batches, leaves, wrapper, field):
            columns = [pa.array([_text(v) for v in c.values], pa.string()) for c in shredder.columns]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], names=["row_key", *fields])

    return map_batches(rows, run, "row_key bigint, " + ", ".join(f"`{c}` string" for c in fields))


_PROPERTY = (("name", "", "name"), ("value", "", "value"), ("raw_type", "type", "rawValue"), ("type", "", "type"), ("inherited", "", "inherited"))
BUILD_TYPE_TABLES = [
    Flat("settings.property", "settings.property*", _PROPERTY),
    Flat("parameters.property", "parameters.property*", _PROPERTY),
    Flat("vcs-root-entries.vcs-root-entry", "vcs-root-entries.vcs-root-entry*", (("id", "", "id"), ("checkout_rules", "", "checkout-rules"), ("root_id", "vcs-root", "id"), ("root_name", "vcs-root", "name"))),
    Flat("steps.step", "steps.step*", (("id", "", "id"), ("name", "", "name"), ("type", "", "type"))),
    Flat("steps.step.properties.property", "steps.step*.properties.property*", _PROPERTY),
]
VCS_ROOT_TABLES = [Flat("properties.property", "properties.property*", (("name", "", "name"), ("value", "", "value"), ("raw_type", "type", "rawvalue")))]


def child() -> SqlColumn:
    """What names an object: a property's name, the id of an entry or step; '' if it has none."""
    named = F.col("path").isin("vcs-root-entries.vcs-root-entry", "steps.step")
    return F.coalesce(F.when(named, F.col("leaves")["id"]).otherwise(F.col("leaves")["name"]), F.lit(""))


def build_type_rows(build_types: DataFrame) -> DataFrame:
    """The flat tables inside ``build_types.payload``."""
    return flat_rows(build_types, "bt_row", "payload", BUILD_TYPE_TABLES, "buildType")


def vcs_root_rows(vcs_roots: DataFrame) -> DataFrame:
    """The flat table inside ``vcs_roots.properties``."""
    return flat_rows(vcs_roots, "vr_row", "properties", VCS_ROOT_TABLES)
