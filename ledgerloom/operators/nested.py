"""Flat tables out of deeply nested JSON, by a bottom-up tree automaton.

Every JSON value is given its states from the states of its children, leaves first: a leaf is
null, blank or scalar, a list has the states of its elements, and an object each state whose rule
accepts the states of its keys' values. (A value may have several states, as one shape can serve in
several places: the automaton is the determinised run of a nondeterministic one, and each
combination of keys and child states is worked out once and remembered.) A record's text must end
in the accepting state of its origin - `reading`, `match` or `corrections` - or is `unreadable`.

Rows come only from routes. A route leads from a parent's state through a key to a child's state
and says which structural variant the child is; without the route, or where the child lacks the
state, there is no row of that variant. An object no route takes keeps its own variant,
`unknown`, named by its keys, so no shape is lost. All variants share the supertype columns

    origin, record_id, child, item_pos, item_name, value_pos

which name the record and the place in it, so any two subtype tables of one record join on them.
`value` holds the leaf as text and `payload` the object a row stands for; `subtype` turns one
variant into typed columns.

The step is a map over rows: no shuffle beyond the removal of redelivered records, no state and
no group, so neither skew nor the size of one record's partition matters.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "origin string, record_id bigint, child string, item_pos bigint, item_name string, value_pos bigint, value string, payload string"

# The typed columns of each object variant's subtype table.
SUBTYPES = {
    "pairing": "invoice_line bigint, po_line bigint, code double, description double",
    "finding": "type string, severity string, cell string, place struct<kind:string,line:bigint>, tolerance struct<percent:string,cent:string>",
    "candidate": "line bigint, code double, description double, reason string",
    "not_compared": "reason string, cell string, place struct<kind:string,line:bigint>",
}
# Variants whose rows are values: their subtype tables hold the value, as text and as a number.
LEAF_VARIANTS = ("field", "line_item", "finding_text", "not_compared_text")

NULL, BLANK, SCALAR, VALUES, RECORD, UNKNOWN = "null", "blank", "scalar", "values", "record", "unknown"
LEAVES = frozenset({NULL, BLANK, SCALAR})
States = frozenset


class Rule(NamedTuple):
    """An object has `state` if it carries one of the keys `any_of`, none of `none_of`, and the
    values of the keys in `typed` that it carries have one of the states listed there."""

    state: str
    any_of: frozenset[str]
    none_of: frozenset[str]
    typed: dict[str, frozenset[str]]


def rule(state: str, any_of: str, none_of: str = "", **typed: str) -> Rule:
    return Rule(state, frozenset(any_of.split()), frozenset(none_of.split()), {k: frozenset(v.split()) for k, v in typed.items()})


RULES = [
    rule("place", "kind line", "fieldtype left read", kind="scalar null", line="scalar null"),
    rule("tolerance", "percent cent"),
    rule("candidate", "code description line", "type invoice_line po_line", reason="scalar null blank"),
    rule("pairing", "invoice_line po_line", "type", invoice_line="scalar null blank", po_line="scalar null blank"),
    rule("finding", "type severity invoice purchase_order receipt", "pairings findings", type="scalar null blank", severity="scalar null blank"),
    rule("not_compared", "texts reason", "type line", reason="scalar null blank"),
    rule("value correction", "kind", kind="scalar", left="null blank scalar values", read="null blank scalar values"),
    rule("line correction", "kind", kind="scalar", left="record null", read="record null"),
    rule("reading", "fields line_items", fields="record null blank scalar values", line_items="record null blank scalar values list"),
    rule("match", "pairings findings not_compared verdict"),
]


class Route(NamedTuple):
    """What a child with `state`, under `key` of a parent with state `parent`, is."""

    parent: str
    key: str
    state: str
    child: str
    #: `object`: one row for the child; `values`: one for each of its values; `record`: one for each value of each key.
    rows: str
    #: Where the row's name comes from: a key of the child (`.type`), its parent's row (`^`), the key itself (`=`), or nowhere.
    name: str = ""


ROUTES = [
    Route("reading", "fields", RECORD, "field", "record", "="),
    Route("reading", "line_items", RECORD, "line_item", "record", "="),
    Route("match", "pairings", "pairing", "pairing", "object"),
    Route("match", "findings", "finding", "finding", "object", ".type"),
    Route("match", "not_compared", "not_compared", "not_compared", "object", ".reason"),
    Route("finding", "candidate", "candidate", "candidate", "object"),
    Route("finding", "invoice", VALUES, "finding_text", "values", "="),
    Route("finding", "purchase_order", VALUES, "finding_text", "values", "="),
    Route("finding", "receipt", VALUES, "finding_text", "values", "="),
    Route("not_compared", "texts", VALUES, "not_compared_text", "values", "^"),
    Route("corrections", "", "value correction", ".kind", "sides", ".fieldtype"),
    Route("corrections", "", "line correction", ".kind", "sides", ".fieldtype"),
]
#: The type and state a whole text must have to be accepted for its origin; a reading or match of no known key is empty, not unreadable.
ACCEPTING = {"reading": dict, "match": dict, "corrections": list}


class Node(NamedTuple):
    """A value with its states; `children` are the nodes of an object's values or a list's elements."""

    value: object
    states: States
    children: object


_LEAF = {s: States({s, VALUES}) for s in (NULL, BLANK, SCALAR)}
_memo: dict[tuple, States] = {}


def _object_states(held: tuple[tuple[str, States], ...]) -> States:
    """The transition for an object, from its keys and their values' states; remembered, as records share few shapes."""
    if (found := _memo.get(held)) is not None:
        return found
    own = dict(held)
    states = {RECORD}
    for r in RULES:
        if r.any_of & own.keys() and not r.none_of & own.keys() and all(own[k] & s for k, s in r.typed.items() if k in own):
            states.add(r.state)
    if len(_memo) > 50_000:
        _memo.clear()
    _memo[held] = States(states)
    return _memo[held]


_lists: dict[States, States] = {}


def run(value: object) -> Node:
    """The automaton's bottom-up run over a value."""
    if value is None:
        return Node(value, _LEAF[NULL], None)
    if isinstance(value, str):
        return Node(value, _LEAF[SCALAR if value.strip() else BLANK], None)
    if isinstance(value, dict):
        children = {k: run(v) for k, v in value.items()}
        return Node(value, _object_states(tuple(sorted((k, c.states) for k, c in children.items()) if len(children) > 1 else ((k, c.states) for k, c in children.items()))), children)
    if isinstance(value, list):
        listed = [run(v) for v in value]
        inner = States().union(*(c.states for c in listed)) if listed else States()
        if (states := _lists.get(inner)) is None:
            # A list that holds a leaf, or nothing, holds values, whatever else is in it.
            states = _lists[inner] = States({"list"} | (inner - LEAVES) - {VALUES} | ({VALUES} if not inner or inner & LEAVES else set()))
        return Node(value, states, listed)
    return Node(value, _LEAF[SCALAR], None)


def states_of(value: object) -> States:
    return run(value).states


def accept(text: str, want: type) -> object | None:
    """The object (or list) a text holds, also where it was written as a JSON string once more."""
    value: object = text
    for _ in range(4):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value.lstrip("﻿"))
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, want) else None


def _leaves(node: Node) -> Iterator[tuple[int, str]]:
    """Place and text of each value written alone or in a list; nulls and blanks only keep their place."""
    for at, x in enumerate(node.children if isinstance(node.value, list) else (node,)):
        if SCALAR in x.states and x.children is None:
            yield at, x.value if isinstance(x.value, str) else json.dumps(x.value)


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


def _routes(routes: Iterable[Route]) -> dict[tuple[str, str], list[Route]]:
    out: dict[tuple[str, str], list[Route]] = {}
    for r in routes:
        out.setdefault((r.parent, r.key), []).append(r)
    return out


_BY_PARENT = _routes(ROUTES)


def _named(source: str, node: Node, key: str, above: str) -> str:
    if source.startswith("."):
        return _text(node.value.get(source[1:])) if isinstance(node.value, dict) else ""
    return above if source == "^" else key if source == "=" else ""


def _emit(route: Route, node: Node, key: str, pos: int, above: str, by_parent: dict) -> Iterator[tuple]:
    name = _named(route.name, node, key, above)
    if route.rows == "object":
        yield route.child, pos, name, -1, None, json.dumps(node.value)
        yield from _below(route.state, node, pos, name, by_parent)
    elif route.rows == "values":
        for at, text in _leaves(node):
            yield route.child, pos, name, at, text, None
    elif route.rows == "record":
        for own, held in node.children.items():
            for at, text in _leaves(held):
                yield route.child, pos, own, at, text, None
    else:  # a correction: what is left and what was read, as values or as a record of values
        kind = _named(route.child, node, key, above)
        for side in ("left", "read"):
            held = node.children.get(side)
            if held is None:
                continue
            named = held.children.items() if isinstance(held.value, dict) else [(name, held)]
            for own, values in named:
                for at, text in _leaves(values):
                    yield kind, pos, own, at, text, None


def _below(state: str, node: Node, pos: int, above: str, by_parent: dict) -> Iterator[tuple]:
    """The rows of the children of a node that was taken as `state`; items of a list under a
    root are numbered, what hangs below an item keeps its number."""
    nested = pos >= 0
    for key, child in node.children.items():
        routes = by_parent.get((state, key))
        if not routes:
            continue
        if routes[0].rows == "values":
            for r in routes:
                if r.state in child.states:
                    yield from _emit(r, child, key, pos, above, by_parent)
            continue
        # An object written without its list counts as the list of it.
        items = child.children if isinstance(child.value, list) else (child,)
        for at, item in enumerate(items):
            if item.children is None or isinstance(item.value, list):
                continue
            taken = next((r for r in routes if r.state in item.states), None)
            place = pos if nested else at
            if taken is None:
                yield UNKNOWN, place, f"{key}: {' '.join(sorted(item.value))}", -1, None, json.dumps(item.value)
            else:
                yield from _emit(taken, item, key, -1 if taken.child == "field" else place, above, by_parent)


def rows(origin: str, value: object, by_parent: dict | None = None) -> Iterator[tuple]:
    """The child rows of an accepted value, by the routes (all of ROUTES unless others are given)."""
    by_parent = _BY_PARENT if by_parent is None else by_parent
    try:
        node = run(value)
    except RecursionError:
        yield "unreadable", -1, "", -1, None, None
        return
    if origin != "corrections":
        if origin in node.states:
            yield from _below(origin, node, -1, "", by_parent)
        return
    for at, item in enumerate(node.children):
        taken = next((r for r in by_parent.get((origin, ""), ()) if r.state in item.states), None)
        if taken is not None:
            yield from _emit(taken, item, "", at, "", by_parent)
        elif isinstance(item.value, dict):
            yield UNKNOWN, at, f"corrections: {' '.join(sorted(item.value))}", -1, None, json.dumps(item.value)


def _shred(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROW.split(", ")]
    for batch in batches:
        out = []
        for origin, record_id, text in zip(batch["origin"], batch["record_id"], batch["text"], strict=True):
            value = accept(text, ACCEPTING[origin])
            if value is None:
                out.append((origin, record_id, "unreadable", -1, "", -1, None, None))
            else:
                out.extend((origin, record_id, *row) for row in rows(origin, value))
        yield pd.DataFrame(out, columns=names)


def shred(df: DataFrame, record_id: str, columns: dict[str, str]) -> DataFrame:
    """Child rows of JSON columns; `columns` maps an origin (a key of ACCEPTING) to its column.

    A null text gives no row. A text from which the origin's object or list can't be read (also
    an empty one, and one nested too deeply to parse) gives one row with child `unreadable`.
    Values that are null, empty or all blank give no row but keep their place. An object where a
    variant belongs but of no known shape gives a row with child `unknown`, named by its keys.
    Repeated keys count once, with the last value. Other columns of `df` are not read.
    """
    parts = [
        df.select(F.lit(origin).alias("origin"), F.col(record_id).cast("long").alias("record_id"), F.col(column).alias("text")).where(F.col(column).isNotNull())
        for origin, column in columns.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.mapInPandas(_shred, ROW)


def subtype(children: DataFrame, child: str) -> DataFrame:
    """The typed table of one variant, with the supertype's keys and the link to its record.

    Variants of values - also each kind of correction - have `value` and, where it reads as one,
    `number`; object variants the columns of SUBTYPES.
    """
    keys = ["origin", "record_id", "item_pos", "item_name"]
    own = children.where(F.col("child") == child)
    if child in SUBTYPES:
        return own.select(*keys, F.from_json("payload", SUBTYPES[child]).alias("_p")).select(*keys, "_p.*")
    return own.select(*keys, "value_pos", "value", F.expr("try_cast(value as double)").alias("number"))


def variants(children: DataFrame) -> DataFrame:
    """`origin, child, shape, n`: the structural variants met - each kind of child with the keys its objects carry."""
    shape = F.coalesce(F.array_join(F.array_sort(F.json_object_keys("payload")), " "), F.lit(""))
    return children.groupBy("origin", "child", shape.alias("shape")).agg(F.count("*").alias("n"))
