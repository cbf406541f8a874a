"""Deeply nested semi-structured records as related flat tables.

Each record streams through an event parser that turns it into
path-value-ordinal triples; paths are grouped by their innermost repeated
ancestor, which the paths themselves tell (a list that holds objects), and each
group is pivoted into one row per list element. What lies under no list is the
row of the record itself. No value is lost: it is a field of its row or an item
of a list of scalars in it. No shuffle: a record's triples never leave the task
that parsed it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Possessive, so damaged text costs linear time. A match takes a whole member or element, with what follows it.
_BLANKS = r"[ \t\n\r]*+"
_STRING = r'"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"'
_SCALAR = rf"(?:{_STRING}|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null))"
_MEMBER = re.compile(rf"{_BLANKS}{_STRING}{_BLANKS}:{_BLANKS}(?:{_SCALAR}{_BLANKS}([,}}])|([{{\[]))")
_ELEMENT = re.compile(rf"{_BLANKS}(?:{_SCALAR}{_BLANKS}([,\]])|([{{\[]))")
_WHOLE = re.compile(rf"{_BLANKS}(?:{_SCALAR}{_BLANKS}\Z|([{{\[]))")
_AFTER = re.compile(rf"{_BLANKS}([,}}\]])")
_EMPTY_OBJECT, _EMPTY_LIST = re.compile(rf"{_BLANKS}\}}"), re.compile(rf"{_BLANKS}\]")
_REST = re.compile(rf"{_BLANKS}\Z")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
MARK = "[]"
ROOT = ""  # list path of the row of the record itself
MAX_DEPTH = 1000  # as Spark's own parser of JSON has it; a deeper text counts as damaged
MAX_PATHS = 200_000  # known to a task at a time; keys may be data
OPENED = object()  # in place of a value: an object begins here


class Damaged(ValueError):
    """The text isn't one complete JSON value."""


@lru_cache(maxsize=65536)
def snake(key: str) -> str:
    """A key in snake_case, whatever its style."""
    return _HUMP.sub("_", key).lower()


def _text(body: str) -> str:
    if "\\" not in body:
        return body
    value = json.loads(f'"{body}"')
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Group:
    """Where the value of a path goes: the innermost repeated ancestor and the path below it."""

    __slots__ = ("head", "holder", "leaf", "passed", "sources", "whole")

    def __init__(self, path: str, lists: frozenset[str], holds: bool):
        """``holds``: the path is that of an object, hence an element if its last step is a list."""
        self.head, self.holder, self.sources, self.passed, below = ROOT, None, (), 0, 0
        parts, names, shown, sources, passed = path.split(".") if path else [], [], [], [], 0
        for i, part in enumerate(parts):
            name = part.rstrip(MARK)
            marks = (len(part) - len(name)) // len(MARK)
            names.append(name)
            listed = ".".join(names) in lists
            own = [None] if listed and not marks else [*range(passed, passed + marks)]  # None: a lone value counts as a list of one
            sources, passed = [*sources, *own], passed + marks
            plain = name.replace("%", "%%")
            if own and (listed or holds or i + 1 < len(parts)):
                self.head = ".".join(names) + MARK * (len(own) - 1)
                self.holder = ".".join([*shown, plain + "[%d]" * (len(own) - 1)] if len(own) > 1 else shown)
                self.sources, self.passed, below = tuple(sources), passed, i + 1
            shown.append(plain + "[%d]" * len(own))
        self.leaf = ".".join(parts[below:])
        self.whole = self.sources == tuple(range(self.passed))

    def own(self, places: tuple[int, ...]) -> tuple[int, ...]:
        return places[: self.passed] if self.whole else tuple(0 if i is None else places[i] for i in self.sources)


class _Path:
    """A node of the tree of all paths seen in a task; what is known of a path is worked out once."""

    __slots__ = ("_item", "by_key", "by_name", "embedded", "kept", "rows", "rules", "text", "values")

    def __init__(self, text: str, rules: _Rules):
        self.text, self.rules, self.embedded = text, rules, text in rules.embedded
        rules.paths += 1
        self.by_key: dict[str, _Path] = {}
        self.by_name: dict[str, _Path] = {}
        self._item: _Path | None = None
        self.values = _Group(text, rules.lists, False)
        below = _Group(text, rules.lists, True)
        element = not text or text.endswith(MARK) or text in rules.plain_lists
        self.rows = below if element and rules.wants(below.head) else None
        self.kept = rules.wants(self.values.head, self.values.leaf)

    def child(self, body: str) -> _Path:
        name = snake(_text(body))
        known = self.by_name.get(name)
        if known is None:
            known = self.by_name[name] = _Path(f"{self.text}.{name}" if self.text else name, self.rules)
        if len(self.by_key) < 65536:
            self.by_key[body] = known
        return known

    def item(self) -> _Path:
        if self._item is None:
            self._item = _Path(self.text + MARK, self.rules)
        return self._item


class _Rules:
    """What the caller wants of a record."""

    def __init__(self, lists: Iterable[str] = (), embedded: Iterable[str] = (), keep: dict[str, Iterable[str] | None] | None = None):
        self.lists, self.embedded = frozenset(lists), frozenset(embedded)
        self.keep = None if keep is None else {head: None if leaves is None else frozenset(leaves) for head, leaves in keep.items()}
        self.plain_lists = _Listed(self.lists)
        self.paths = 0

    def wants(self, head: str, leaf: str | None = None) -> bool:
        if self.keep is None:
            return True
        leaves = self.keep.get(head, ())
        return head in self.keep and (leaf is None or leaves is None or leaf in leaves)


class _Listed:
    """Paths, with or without marks, whose last step is a list by the caller's word."""

    def __init__(self, lists: frozenset[str]):
        self.lists = lists

    def __contains__(self, path: str) -> bool:
        return path.replace(MARK, "") in self.lists


def triples(text: str, root: _Path, places: tuple[int, ...] = ()) -> list[tuple[_Path, tuple[int, ...], object]]:
    """(path, ordinals, value) of each scalar of a JSON text, in its order; Damaged if it is not one complete value.

    A path has the keys in snake_case and ``[]`` for each list passed; ordinals
    has one position per ``[]``. Values are text; nulls are left out; where an
    object begins, the value is ``OPENED``. A string at an embedded path that is
    itself a JSON text is parsed in its place. The parser goes through the text
    once, from token to token, with a stack of its own of ``MAX_DEPTH`` at most.
    """
    out: list[tuple[_Path, tuple[int, ...], object]] = []

    def scalar(path: _Path, here: tuple[int, ...], body: str | None, value: str | None) -> None:
        if body is not None:
            value = body if "\\" not in body else _text(body)
            if path.embedded:
                try:
                    out.extend(triples(value, path, here))
                    return
                except Damaged:
                    pass
        if path.kept:
            out.append((path, here, value))

    start = _WHOLE.match(text)
    if not start:
        raise Damaged("no value")
    body, number, literal, opened = start.groups()
    if opened is None:
        if literal != "null":
            scalar(root, places, body, number or literal)
        return out
    at, fresh, position = start.end(), True, 0
    is_list = opened == "["
    path, here = (root.item(), (*places, 0)) if is_list else (root, places)
    stack: list[tuple[bool, _Path, tuple[int, ...], int]] = []
    member, element = _MEMBER.match, _ELEMENT.match
    while True:
        closed = False
        if fresh:
            fresh = False
            if not is_list and path.rows is not None:
                out.append((path, here, OPENED))
            if end := (_EMPTY_LIST if is_list else _EMPTY_OBJECT).match(text, at):
                at, closed = end.end(), True
        if not closed:
            if is_list:
                if not (found := element(text, at)):
                    raise Damaged(f"at {at}")
                body, number, literal, mark, opened = found.groups()
                target = path
            else:
                if not (found := member(text, at)):
                    raise Damaged(f"at {at}")
                key, body, number, literal, mark, opened = found.groups()
                target = path.by_key.get(key) or path.child(key)
            at = found.end()
            if opened is not None:
                stack.append((is_list, path, here, position))
                if len(stack) > MAX_DEPTH:
                    raise Damaged("too deep")
                is_list = opened == "["
                path, here, position = (target.item(), (*here, 0), 0) if is_list else (target, here, 0)
                fresh = True
                continue
            if literal != "null" and (target.kept or target.embedded):
                scalar(target, here, body, number or literal)
            if mark == ",":
                if is_list:
                    position += 1
                    here = (*here[:-1], position)
                continue
        while stack:
            is_list, path, here, position = stack.pop()
            found = _AFTER.match(text, at)
            if not found:
                raise Damaged(f"at {at}")
            at, mark = found.end(), found.group(1)
            if mark == ",":
                if is_list:
                    position += 1
                    here = (*here[:-1], position)
                break
            if (mark == "]") != is_list:
                raise Damaged(f"at {at}")
        else:
            if not _REST.match(text, at):
                raise Damaged("text after the value")
            return out


Lists = dict[str, list[tuple[tuple[int, ...], str]]]


def nodes_of(text: str | None, root: _Path) -> list[tuple[_Group, tuple[int, ...], dict[str, str], Lists]]:
    """The rows of a record as (group, ordinals, values by path below the element, items of lists of scalars by path).

    Triples are grouped by their innermost repeated ancestor. Of several values
    for one path and ordinals the last counts. Nothing for a null text, or one
    that isn't a complete JSON object.
    """
    if text is None or not text.lstrip(" \t\n\r").startswith("{"):
        return []
    try:
        found = triples(text, root)
    except Damaged:
        return []
    groups: dict[tuple[str, tuple[int, ...]], tuple[_Group, dict[str, str], dict]] = {}
    for path, places, value in found:
        group = path.rows if value is OPENED else path.values
        own = places[: group.passed] if group.whole else group.own(places)
        row = groups.get((group.head, own))
        if row is None:
            row = groups[group.head, own] = (group, {}, {})
        if value is not OPENED:
            if len(places) > group.passed:
                row[2].setdefault(group.leaf, {})[places[group.passed :]] = value
            else:
                row[1][group.leaf] = value
    return [(group, own, values, {leaf: list(items.items()) for leaf, items in lists.items()}) for (_, own), (group, values, lists) in groups.items()]


_ITEM = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("value", T.StringType())])
NODE_FIELDS = [
    T.StructField("list_path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("node_pos", T.IntegerType()),
    T.StructField("places", T.ArrayType(T.IntegerType())),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(_ITEM))),
]


class _Rows:
    """Rows as flat Arrow buffers, which cost far less than nested Python values."""

    def __init__(self) -> None:
        self.owner: list[int] = []
        self.head: list[str] = []
        self.holder: list[str | None] = []
        self.position: list[int | None] = []
        self.places, self.place_ends = [], [0]
        self.names, self.values, self.field_ends = [], [], [0]
        self.list_names, self.list_ends = [], [0]
        self.items, self.item_ends = [], [0]
        self.item_places, self.item_place_ends = [], [0]

    def add(self, owner: int, group: _Group, own: tuple[int, ...], values: dict[str, str], lists: Lists) -> None:
        self.owner.append(owner)
        self.head.append(group.head)
        self.holder.append(None if group.holder is None else group.holder % own[:-1] if "%" in group.holder else group.holder)
        self.position.append(own[-1] if own else None)
        self.places += own
        self.place_ends.append(len(self.places))
        self.names += values.keys()
        self.values += values.values()
        self.field_ends.append(len(self.names))
        for name, items in lists.items():
            self.list_names.append(name)
            for places, value in items:
                self.item_places += places
                self.item_place_ends.append(len(self.item_places))
                self.items.append(value)
            self.item_ends.append(len(self.items))
        self.list_ends.append(len(self.list_names))

    def arrays(self) -> list[pa.Array]:
        int32, text = pa.int32(), pa.string()
        ends = lambda e: pa.array(e, int32)
        item = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends(self.item_place_ends), pa.array(self.item_places, int32)), pa.array(self.items, text)], names=["places", "value"])
        lists = pa.MapArray.from_arrays(ends(self.list_ends), pa.array(self.list_names, text), pa.ListArray.from_arrays(ends(self.item_ends), item))
        fields = pa.MapArray.from_arrays(ends(self.field_ends), pa.array(self.names, text), pa.array(self.values, text))
        return [pa.array(self.head, text), pa.array(self.holder, text), pa.array(self.position, int32), pa.ListArray.from_arrays(ends(self.place_ends), pa.array(self.places, int32)), fields, lists]


def flatten(records: DataFrame, key: str, payload: str, lists: Iterable[str] = (), embedded: Iterable[str] = (), keep: dict[str, Iterable[str] | None] | None = None) -> DataFrame:
    """One row per record and per element of each list that holds objects, at any depth.

    The lists are found from the paths. ``lists``: dotted paths that are lists
    even where a lone value stands for a list of one, or where they hold scalars.
    ``embedded``: paths whose strings may themselves be JSON texts. ``keep``
    prunes: only the rows of these list paths (``ROOT`` is the record) with only
    these paths below them (None for all) come out; the whole text is read anyhow.

    Result: ``key``, ``list_path`` (content.assets), ``parent_path`` (path of the
    object holding the list, as content.assets[2]), ``node_pos``, ``places``
    (positions from the root; those of the parent are their beginning), ``fields``
    (scalars by path below the element) and ``lists`` (lists of scalars by path,
    as bbox[], with the positions below the element). A list within a list is
    named by its marks: a[] for the inner lists of a. Positions count null
    elements, which give no row; an empty object gives a row. Equal records are
    taken once, before they are parsed. Records without a complete JSON object
    give nothing. Keys that hold a full stop can't be told from steps of a path.
    """
    rules = (tuple(lists), tuple(embedded), None if keep is None else {h: None if p is None else tuple(p) for h, p in keep.items()})
    source = records.select(F.col(key).alias(key), F.col(payload).cast("string").alias("payload")).distinct()
    schema = T.StructType([source.schema[key], *NODE_FIELDS])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _Path(ROOT, _Rules(*rules))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = _Rows()
                if root.rules.paths > MAX_PATHS:
                    root = _Path(ROOT, _Rules(*rules))
                for i, text in enumerate(part.column(1).to_pylist()):
                    for node in nodes_of(text, root):
                        rows.add(i, *node)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows.owner, pa.int64())), *rows.arrays()], names=schema.names)

    return source.mapInArrow(parse, schema)


def items(path: str) -> Column:
    """A list of scalars below the element as an array of text, each value at its position; a lone value is a list of one."""
    held = F.col("lists")[path + MARK]
    places = F.sequence(F.lit(0), F.array_max(F.transform(held, lambda x: x["places"][0])))
    each = F.transform(places, lambda i: F.get(F.filter(held, lambda x: x["places"][0] == i), F.lit(0))["value"])
    alone = F.col("fields")[path]
    return F.coalesce(each, F.when(alone.isNotNull(), F.array(alone)))


def under(path: str) -> Column:
    """All values below a part of the element, in lists or not, as sorted (path below the part, places, value); empty if there are none."""
    start = f"{path}."
    cut = lambda name: F.substring(name, len(start) + 1, 1 << 30)
    lone = F.transform(F.map_entries(F.map_filter("fields", lambda k, _: k.startswith(start))), lambda e: F.struct(cut(e["key"]).alias("path"), F.array().cast("array<int>").alias("places"), e["value"].alias("value")))
    many = F.transform(F.map_entries(F.map_filter("lists", lambda k, _: k.startswith(start))), lambda e: F.transform(e["value"], lambda x: F.struct(cut(e["key"]).alias("path"), x["places"].alias("places"), x["value"].alias("value"))))
    return F.array_sort(F.concat(lone, F.flatten(many)))


def pivot(nodes: DataFrame, key: str, list_path: str, fields: dict[str, str]) -> DataFrame:
    """The elements of one list as a table: ``key``, ``parent_path``, ``node_pos``, ``places`` and a column per field.

    ``fields`` maps column names to paths below the element.
    """
    values: list[Column] = [F.col("fields")[path].alias(name) for name, path in fields.items()]
    return nodes.where(F.col("list_path") == list_path).select(key, "parent_path", "node_pos", "places", *values)


def list_table(nodes: DataFrame, key: str, list_path: str, path: str) -> DataFrame:
    """A list of scalars below the elements of ``list_path`` as a child table: ``key``, ``places`` of the element, ``item_pos``, ``value``; a lone value is a list of one."""
    held = nodes.where(F.col("list_path") == list_path).select(key, "places", F.col("lists")[path + MARK].alias("_many"), F.col("fields")[path].alias("_lone"))
    lone = F.when(F.col("_lone").isNotNull(), F.array(F.struct(F.array(F.lit(0)).alias("places"), F.col("_lone").alias("value"))))
    each = held.select(key, "places", F.explode(F.coalesce("_many", lone)).alias("_i"))
    return each.select(key, "places", F.element_at("_i.places", -1).alias("item_pos"), F.col("_i.value").alias("value"))


def path_report(nodes: DataFrame) -> DataFrame:
    """What the records hold: ``list_path``, ``path`` below the element ([] marks lists), ``n_values`` and ``n_rows`` that have any."""
    lone = F.transform(F.map_keys("fields"), lambda k: F.struct(k.alias("path"), F.lit(1).alias("n")))
    many = F.transform(F.map_entries("lists"), lambda e: F.struct(e["key"].alias("path"), F.size(e["value"]).alias("n")))
    each = nodes.select("list_path", F.explode(F.concat(lone, many)).alias("p"))
    return each.groupBy("list_path", F.col("p.path").alias("path")).agg(F.sum("p.n").alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
