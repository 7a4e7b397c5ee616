"""Deeply nested JSON records to flat related tables, by Merkle subtree identities.

Every object (and every plain entry of a list) becomes a node. A node's identity
is the hash of its canonical form, in which nested objects stand only as their
own hashes, so equal subtrees have equal identities wherever they occur:

* ``occurrences``: one bridge row per place a node stands in, with its parent
  place, field, ordinal and the positions of all lists above it;
* ``objects``: one row per distinct node, however often it occurs.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "source string, record_id bigint, node string, parent_node string, route string, field string, "
    "ordinal int, pos string, parent_pos string, kind string, node_hash string, payload string"
)
_ARROW = pa.schema(
    [pa.field(n, {"bigint": pa.int64(), "int": pa.int32()}.get(t, pa.string())) for n, t in (c.split() for c in NODE_SCHEMA.split(", "))]
)
_DECODER = json.JSONDecoder(parse_constant=lambda name: _reject(name))
_BLANK = " \t\n\r"


def _reject(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _parse_deep(text: str) -> object:
    """Parse with an explicit stack; for records nested beyond the C parser's limit."""
    scalar = json.JSONDecoder(parse_constant=_reject).raw_decode
    holder: list = []
    stack: list[tuple[object, str | None]] = []
    here: object = holder
    key: str | None = None
    i, n, done = 0, len(text), False

    def put(value: object) -> None:
        here.append(value) if isinstance(here, list) else here.__setitem__(key, value)

    def skip(j: int) -> int:
        while j < n and text[j] in _BLANK:
            j += 1
        return j

    i = skip(0)
    expect_value, may_close = True, False
    while not done:
        if i >= n:
            raise ValueError("record ends too early")
        c = text[i]
        if expect_value and isinstance(here, dict) and key is None:
            if c == "}" and may_close:
                expect_value = False
                continue
            if c != '"':
                raise ValueError("a key is missing")
            key, i = scalar(text, i)
            i = skip(i)
            if text[i : i + 1] != ":":
                raise ValueError("a colon is missing")
            i, may_close = skip(i + 1), False
            continue
        if expect_value and not (c == "]" and may_close and isinstance(here, list) and here is not holder):
            if c in "{[":
                inner: object = {} if c == "{" else []
                put(inner)
                stack.append((here, key))
                here, key, i, may_close = inner, None, skip(i + 1), True
                continue
            value, i = scalar(text, i)
            put(value)
            expect_value = False
        elif c == ("}" if isinstance(here, dict) else "]") and stack:
            here, key = stack.pop()
            i, expect_value = i + 1, False
        elif c == "," and stack:
            i, key, expect_value, may_close = skip(i + 1), None, True, False
            continue
        else:
            raise ValueError("unexpected character")
        i = skip(i)
        if not stack:
            done = True
    if i != n:
        raise ValueError("text after the record")
    return holder[0]


def parse_json(text: str) -> object:
    """The parsed value; ValueError for anything that is not JSON."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text.strip(_BLANK))


def _decoded(value: object) -> object:
    """A text that encodes an object or list counts as what it encodes."""
    while isinstance(value, str):
        lead = value.lstrip(_BLANK)[:1]
        if lead not in ("{", "[", '"'):
            return value
        try:
            inner = parse_json(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def record_nodes(value: object, list_fields: frozenset[str] = frozenset()) -> list[tuple]:
    """All nodes of one parsed record: (node, parent, route, field, ordinal, pos, parent_pos, kind, hash, payload).

    Children come before their parents, as hashes are built bottom-up. Nulls in
    lists keep their position and give no node. A lone object under one of
    ``list_fields`` counts as position 0 of a list.
    """
    out: list[tuple] = []
    value = _decoded(value)
    frames: list[tuple] = []

    def open_frame(own: tuple, place: tuple | None, member: dict) -> None:
        node, _, route, _, _, pos, _ = own
        todo: list[tuple] = []
        refs: dict[str, object] = {}
        for key in member:
            spread(todo, refs, key, _decoded(member[key]), node, f"{route}.{key}" if route else key, pos)
        frames.append((own, place, todo, refs))

    def spread(todo: list, refs: dict, key: str, v: object, node: str, route: str, pos: str) -> None:
        """Note a member's canonical form in refs and its child nodes in todo."""
        refs[key] = v
        if isinstance(v, dict):
            here = (f"{pos}/0" if pos else "0") if key in list_fields else pos
            todo.append(((refs, key), (f"{node}/{key}", node, route, key, 0, here, pos), v))
        elif isinstance(v, list):
            work = [(refs, key, v, pos, f"{node}/{key}")]
            while work:
                into, at, items, above, base = work.pop()
                slots: list = [None] * len(items)
                into[at] = slots
                for i, item in enumerate(items):
                    item, here = _decoded(item), f"{above}/{i}" if above else str(i)
                    if isinstance(item, list):
                        work.append((slots, i, item, here, f"{base}/{i}"))
                    elif item is not None:
                        todo.append(((slots, i), (f"{base}/{i}", node, route, key, i, here, pos), item))

    def emit(own: tuple, kind: str, payload: str) -> str:
        digest = hashlib.blake2b(kind.encode() + payload.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        out.append((*own, kind, digest, payload))
        return digest

    open_frame(("", None, "", None, 0, "", ""), None, value if isinstance(value, dict) else {"": value})
    while frames:
        own, place, todo, refs = frames[-1]
        if todo:
            (into, at), child, v = todo.pop()
            if isinstance(v, dict):
                open_frame(child, (into, at), v)
            else:
                into[at] = v
                emit(child, "value", json.dumps(v, ensure_ascii=False))
            continue
        frames.pop()
        digest = emit(own, "object", json.dumps(refs, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        if place:
            place[0][place[1]] = {"$ref": digest}
    return out


def nested_nodes(df: DataFrame, record_id: str, json_col: str, source: str, list_fields: frozenset[str] = frozenset(), keep_routes: str | None = None) -> DataFrame:
    """Nodes of every readable record of ``df`` (columns: ``NODE_SCHEMA``).

    Null and unreadable records, and null record ids, give no rows; a record
    delivered several times gives its nodes once. ``keep_routes``: a pattern of
    the routes (field names joined with dots) to return; hashing covers all.
    Positions count from 0; a lone object under one of ``list_fields``, whose
    values should be lists, is position 0.
    """
    import re

    wanted = re.compile(keep_routes) if keep_routes else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = parse_json(text)
                except ValueError:
                    continue
                rows += [(source, rid, *n) for n in record_nodes(value, list_fields) if wanted is None or wanted.fullmatch(n[2])]
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    read = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(json_col).alias("j")).where("record_id is not null and j is not null")
    return read.distinct().mapInArrow(run, NODE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    clean = [[_storable(v) if isinstance(v, str) else v for v in column] for column in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(clean, _ARROW)], schema=_ARROW)


def _storable(text: str) -> str:
    """Lone surrogates, which JSON escapes may hold, can't be stored as UTF-8."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


def occurrences(nodes: DataFrame) -> DataFrame:
    """The bridge: every place a node stands in, without its content."""
    return nodes.drop("payload").distinct()


def objects(nodes: DataFrame) -> DataFrame:
    """Each distinct node once: node_hash, kind, payload (nested objects as ``{"$ref": hash}``)."""
    return nodes.select("node_hash", "kind", "payload").distinct()


def with_content(places: DataFrame, contents: DataFrame) -> DataFrame:
    """Places joined to the content of their nodes by identity."""
    return places.join(contents.select("node_hash", "payload"), "node_hash")


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def micros(text: Column) -> Column:
    """A number given as number or text, times 1,000,000, as a whole number; null for anything else."""
    return F.when(text.rlike(NUMBER), F.round(F.trim(text).try_cast("double") * 1_000_000).cast("bigint"))


#: Fields of the records that should hold lists.
LISTS = frozenset({"sections", "children", "examples", "citations"})


def found(packages: DataFrame, catalog: DataFrame) -> DataFrame:
    """p1: sections, costs, examples and citations as rows (record_kind, record_id, pos, parent_pos)."""
    from lodestrata.session import materialize

    nav = nested_nodes(packages, "package_id", "doc_nav", "doc_nav", LISTS, r"sections(\.children)*")
    cost = nested_nodes(packages, "package_id", "manifest", "manifest", LISTS, r"processing\.cost_estimate(\.by_model)?")
    cat = nested_nodes(catalog, "catalog_line", "record_json", "catalog", LISTS, r"catalog_metadata\.examples(\.question|\.citations)?")
    nodes = materialize(nav.unionByName(cost).unionByName(cat), "p1-nodes")
    places = occurrences(nodes)
    content = objects(nodes.where("source <> 'doc_nav' and not route like '%.citations'"))
    obj = F.col("kind") == "object"

    sections = places.where(obj & (F.col("source") == "doc_nav")).select(F.lit("nav_section").alias("record_kind"), "record_id", "pos", "parent_pos")
    filled = with_content(places.where(obj & (F.col("source") != "doc_nav") & ~F.col("route").endswith(".citations")), content)
    models = filled.where(F.col("route").endswith("by_model")).select(
        F.lit("cost_model").alias("record_kind"), "record_id", F.explode(F.json_object_keys("payload")).alias("pos"), F.lit("").alias("parent_pos")
    )
    totals = (
        filled.where(F.col("route") == "processing.cost_estimate")
        .select(F.lit("total_cost").alias("record_kind"), "record_id", micros(F.get_json_object("payload", "$.total_cost")).cast("string").alias("pos"), F.lit("").alias("parent_pos"))
        .where("pos is not null")
    )
    asked = filled.where(F.col("route") == "catalog_metadata.examples").where(_has_text("question")).select("record_id", "pos")
    asked_inside = filled.where(F.col("route") == "catalog_metadata.examples.question").where(_has_text("text")).select("record_id", F.col("parent_pos").alias("pos"))
    examples = asked.union(asked_inside).select(F.lit("example").alias("record_kind"), "record_id", "pos", F.lit("").alias("parent_pos"))
    citations = places.where(F.col("route") == "catalog_metadata.examples.citations").select(F.lit("citation").alias("record_kind"), "record_id", "pos", "parent_pos")
    return sections.union(models).union(totals).union(examples).union(citations).distinct()


def _has_text(key: str) -> Column:
    """The member is a text (not a reference to an object, not null) with something in it besides white space."""
    text = F.get_json_object("payload", f"$.{key}")
    return text.isNotNull() & ~text.startswith('{"$ref"') & ~text.startswith("[") & text.rlike(r"(?U)[^\s]")
