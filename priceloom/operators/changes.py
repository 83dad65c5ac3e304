"""Apply a change set to a book with optimistic revisions."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import IDENTITY_FIELDS, digest, price_key
from ..functions.text import normalize_text
from .governance import derive
from .reconcile import EDITABLE

PARTS = [*IDENTITY_FIELDS, "price"]
_NUMBERS = ("price", "quantity")


def _parts(df: DataFrame, given: bool) -> DataFrame:
    """Adds the parts of the dedup key as text; of edits only those of the fields given."""
    made = {f"_p_{f}": (price_key(F.col(f)) if f == "price" else normalize_text(F.coalesce(F.col(f), F.lit("")))).cast("string") for f in PARTS}
    return df.withColumns({k: F.when(F.col(k[3:]).isNotNull(), v) if given else v for k, v in made.items()})


def _node(parts: list, rest: "F.Column") -> "F.Column":
    """A key as a number, of its parts that updates name and of the number of its other parts.  Keys of one number fall into one
    connected part, which a part may be a union of; each stays a key of its own."""
    return F.xxhash64(rest, *parts)


def _as_is(f: str) -> "F.Column":
    """Surely what an accepted update makes of the field where it does not give it: then the row is settled without it."""
    c = F.col(f)
    if f == "price":
        sure = c.cast("double") > 0
        return F.coalesce(sure & ~F.isnan(c.cast("double")), F.lit(False))
    if f == "quantity":
        return c.isNull() | ~F.isnan(c.cast("double"))
    return F.coalesce(c.rlike(r"(?s)\A[!-~](.*[!-~])?\z") | ((c == "") & F.lit(f != "name")), F.lit(False))


def _parts_of_items(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, label) and (node, label) of the graph of distinct ``edges`` (item, node).

    An item joins its nodes to its smallest one.  Items of one node join nothing, and items of equal nodes the same: only the
    distinct joins of the rest are searched for connected parts.
    """
    from ..session import materialize

    c = F.col
    items = materialize(edges.groupBy("item").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count(F.lit(1)).alias("nodes")), "items", "zstd")
    joins = items.filter("nodes = 2").select("head", c("last").alias("node")).unionByName(
        edges.join(items.filter("nodes > 2").select("item", "head"), "item").filter("head != node").select("head", "node"))
    joins = materialize(joins.distinct(), "joins", "zstd")
    labels = _components(joins.select(c("head").alias("item"), "node").unionByName(
        joins.select(c("head").alias("item"), c("head").alias("node")).distinct()))
    of_item = items.join(labels, items["head"] == labels["node"], "left").select("item", F.coalesce("label", "head").alias("label"))
    of_node = edges.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return of_item, of_node


def _components(edges: DataFrame) -> DataFrame:
    """(node, label) of the graph of ``edges`` (item, node): the smallest node of each connected part.

    Each round takes the nearest label through shared items, then the label's own label,
    which halves the way that is left.
    """
    from ..session import materialize

    labels = materialize(edges.select("node").distinct().withColumn("label", F.col("node")), "labels")
    while True:
        per_item = edges.join(labels, "node").groupBy("item").agg(F.min("label").alias("low"))
        nearer = edges.join(per_item, "item").groupBy("node").agg(F.min("low").alias("low"))
        step = labels.join(nearer, "node").select("node", F.col("label").alias("was"), "low")
        over = labels.select(F.col("node").alias("low"), F.col("label").alias("_beyond"))
        following = materialize(step.join(over, "low").select(
            "node", F.least("low", "_beyond").alias("label"), (F.least("low", "_beyond") < F.col("was")).alias("moved")), "labels")
        labels = following.select("node", "label")
        if following.filter("moved").limit(1).count() == 0:
            return labels


def _settle(open_parts: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Go through the events of each component in order; what is held is the state of one component.

    First come the book's rows (phase 0) and the first holder of each key (1), then deletes,
    updates and creates (2, 3, 4).  A row holds the fields that were sent; the others stay as they are.
    """
    key_columns = ["_rest", *[f"_p_{f}" for f in open_parts]]

    def key(row):
        return tuple(row[x] for x in key_columns)

    def settle(batches):
        label, rows, index = None, {}, {}
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            out = []
            for e in pdf.to_dict("records"):
                if e["label"] != label:
                    label, rows, index = e["label"], {}, {}
                if e["phase"] == 0:
                    sent = int(e["_sent"])
                    rows[e["id"]] = {"revision": e["actual"], **{k: e[k] for k in key_columns}, **{f: e[f] for i, f in enumerate(EDITABLE) if sent >> i & 1}}
                    continue
                if e["phase"] == 1:
                    index[key(e)] = e["id"]
                    continue
                row, op, changed, holder, reason, revision = rows.get(e["id"]), e["op"], [], None, None, None
                kept = row if row and op == "update" else dict.fromkeys(EDITABLE)
                merged = {f: e[f] if e[f] is not None else kept[f] for f in EDITABLE if e[f] is not None or f in kept}
                merged = {f: float(v or 0) if f == "price" else v if f == "quantity" else (v or "").strip() for f, v in merged.items()}
                parts = {f"_p_{f}": e[f"_p_{f}"] if e[f] is not None else row[f"_p_{f}"] if row and op == "update" else "0.0" if f == "price" else "" for f in open_parts}
                parts["_rest"] = row["_rest"] if row and op == "update" else e["_rest"]
                if op != "create" and row is None:
                    reason = "missing"
                elif op != "create" and e["revision"] is not None and e["revision"] != row["revision"]:
                    reason = "revision_mismatch"
                elif op == "delete":
                    if index.get(key(row)) == e["id"]:
                        del index[key(row)]
                    del rows[e["id"]]
                elif e["bad_fields"] or not merged.get("name", True) or merged.get("price", 1) < 0:
                    reason = "invalid"
                else:
                    holder = index.get(key(parts))
                    if holder is not None and holder != e["id"]:
                        reason = "duplicate_key"
                    else:
                        holder = None
                        if op == "update":
                            changed = [f for f in EDITABLE if f in merged and merged[f] != row[f]]
                            if changed:
                                if index.get(key(row)) == e["id"]:
                                    del index[key(row)]
                                row["revision"] += 1
                            revision = row["revision"]
                        else:
                            row, revision = {"revision": 1}, 1
                            rows[e["id"]] = row
                        if changed or op == "create":
                            row.update(merged, **parts)
                            index[key(parts)] = e["id"]
                status = "ok" if reason is None else "conflict" if reason in ("revision_mismatch", "duplicate_key") else "rejected"
                out.append({"seq": e["seq"], "op": op, "id": e["id"], "status": status, "reason": reason, "holder": holder, "changed": changed,
                            "revision": revision, **{f: merged.get(f) for f in EDITABLE}})
            yield pd.DataFrame(out, columns=["seq", "op", "id", "status", "reason", "holder", "changed", "revision", *EDITABLE])

    return settle


def apply_changes(history: DataFrame, changes: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new book, results) for ``changes``: seq, op (delete, update, create), id, revision, bad_fields (count of unknown
    or read-only fields) and the edited fields (NULL = keep).  ``max_rows``: refuse larger sets.

    Deletes come first and free their keys, then updates, then creates, each by seq.  An
    edit meets what the accepted ones before it left: the second update of an id has the
    revision and values after the first; an edit of a row deleted in the same set is
    ``missing``; the key of a deleted or renamed holder is free even where an equal row
    stays in the book.

    Edits depend on each other through ids and through keys they may take.  Connected parts
    of that graph are settled each in order, streamed, so a task holds the state of one part
    at a time; all other work is joins by id or key.  What moves is narrow: ids and keys as numbers, of the book's rows only the
    fields that some update gives (or that a change would tidy), and one digest for the parts of a key that no update gives.
    """
    from ..session import materialize

    c = F.col
    if max_rows and changes.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"a change set may hold at most {max_rows} rows")
    edits = materialize(changes.select("seq", "op", "id", "revision", "bad_fields", *EDITABLE), "edits", "zstd")
    counts = edits.filter("op = 'update'").agg(*[F.count(f).alias(f) for f in EDITABLE]).first()
    given = [f for f in EDITABLE if counts[f]]
    open_parts, closed = [f for f in PARTS if f in given], [f for f in PARTS if f not in given]
    none = {f: F.lit("0.0" if f == "price" else "") for f in PARTS}
    opened = [f"_p_{f}" for f in open_parts]
    of_id, of_new = F.xxhash64(F.lit("id:"), c("id")), F.xxhash64(F.lit("new:"), c("seq"))

    def hashed(column: str) -> "F.Column":
        return F.xxhash64(column)

    book = _parts(history, False).withColumns({
        "item": of_id, "_number": F.xxhash64(F.lit(0), *[c(f"_p_{f}") for f in closed]), "_rest": digest(*[c(f"_p_{f}") for f in closed], F.lit(""))})
    book = book.withColumn("node", _node([hashed(x) for x in opened], c("_number")))
    named = book.filter(c("id").isNotNull())
    # Only a create says all parts; what it leaves out is empty.  Updates never give the closed ones.
    said = _parts(edits, True).withColumns({f"_c_{f}": F.coalesce(f"_p_{f}", none[f]) for f in PARTS})
    created = F.coalesce("op", F.lit("")) == "create"
    made_node = _node([hashed(f"_c_{f}") for f in open_parts], F.xxhash64(F.lit(0), *[c(f"_c_{f}") for f in closed]))
    asked = edits.filter("op != 'create'").select(of_id.alias("item")).distinct()
    stored = materialize(named.select("item", "node").join(asked, "item", "left_semi"), "stored", "zstd")
    # Rows that share an id come to have the fields of one of them: then all fields are sent.
    if stored.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        given = list(EDITABLE)
    # Keys an id may come to have: each part as stored or as any of its edits says.
    renamed = said.filter(c("op") == "update").filter(F.coalesce(*[c(x) for x in opened]).isNotNull() if opened else F.lit(False))
    renamed = renamed.select(of_id.alias("item"), F.lit(None).cast("long").alias("_number"), *[F.when(c(x).isNotNull(), hashed(x)).alias(x) for x in opened])
    own = named.select("item", "_number", *[hashed(x).alias(x) for x in opened]).join(renamed.select("item").distinct(), "item", "left_semi")
    reach = renamed.unionByName(own).groupBy("item").agg(*[F.collect_set(x).alias(x) for x in ("_number", *opened)])
    for x in ("_number", *opened):
        reach = reach.withColumn(x, F.explode(x))
    edges = stored.unionByName(reach.select("item", _node([c(x) for x in opened], c("_number")).alias("node"))).unionByName(
        said.filter(created).select(of_new.alias("item"), made_node.alias("node")))
    # A create meets what other edits do with its id.
    taken = said.filter(created & c("id").isNotNull()).select(of_id.alias("item"), made_node.alias("node")).join(asked, "item", "left_semi")
    edges = materialize(edges.unionByName(taken).distinct(), "edges", "zstd")
    of_item, of_node = _parts_of_items(edges)
    of_item, of_node = materialize(of_item, "of_item", "zstd"), materialize(of_node, "of_node", "zstd")
    # The book's first row of each key that is in play.  A key has one node, and this one label.
    first = book.select("node", "id", "rowid", "_rest", *opened).join(of_node, "node").groupBy("node", "_rest", *opened).agg(
        F.min("label").alias("label"), F.min_by("id", "rowid").alias("id")).drop("node")
    phase = F.when(c("op") == "delete", 2).when(c("op") == "update", 3).otherwise(4)
    whole = F.when(~F.coalesce("op", F.lit("")).isin("update", "delete"), digest(*[c(f"_c_{f}") for f in closed], F.lit("")))
    labelled = said.withColumns({"item": F.when(created, of_new).otherwise(of_id), "_rest": whole}).drop(
        *[f"_c_{f}" for f in PARTS], *[f"_p_{f}" for f in closed]).join(of_item, "item", "left")
    # Edits of unknown ids touch nothing; they go where their id sends them.
    events = labelled.withColumns({"label": F.coalesce("label", "item"), "phase": phase}).drop("item")
    sends = {f: F.lit(True) if f in given else ~_as_is(f) for f in EDITABLE}
    sent = sum((F.when(sends[f], 1 << i).otherwise(0) for i, f in enumerate(EDITABLE)), F.lit(0))
    held = named.select("item", "id", c("revision").alias("actual"), sent.alias("_sent"), "_rest", *opened,
                        *[c(f) if f in given else F.when(sends[f], c(f)).alias(f) for f in EDITABLE]).join(of_item, "item").drop("item")
    every = events.unionByName(held.withColumn("phase", F.lit(0)), allowMissingColumns=True).unionByName(first.withColumn("phase", F.lit(1)), allowMissingColumns=True)
    schema = (f"seq {edits.schema['seq'].dataType.simpleString()}, op string, id string, status string, reason string, holder string, changed array<string>, revision int, "
              + ", ".join(f"{f} {'double' if f in _NUMBERS else 'string'}" for f in EDITABLE))
    done = materialize(every.repartition("label").sortWithinPartitions("label", "phase", "seq", "id").mapInPandas(_settle(open_parts), schema), "settled", "zstd")
    gone = done.filter("status = 'ok' AND op = 'delete'").select("id")
    latest = Window.partitionBy("id").orderBy(c("seq").desc())
    fresh = done.filter("status = 'ok' AND op = 'update' AND size(changed) > 0").withColumn("_place", F.row_number().over(latest)).filter("_place = 1")
    fresh = fresh.select("id", *[c(f).alias(f"_u_{f}") for f in EDITABLE], c("revision").alias("_revision"))
    made = done.filter("status = 'ok' AND op = 'create'").select(
        "id", *EDITABLE, F.lit("表格编辑").alias("source_file"), F.lit("").alias("source_sheet"), F.lit(0).alias("source_row"),
        F.lit(0).alias("source_priority"), F.lit(1).alias("revision"))
    # Fields that were not sent are as they were.
    as_was = {f: F.when(~F.isnan(c(f).cast("double")), c(f)) if f == "quantity" else c(f) for f in EDITABLE}
    rest = history.join(gone, "id", "left_anti").join(fresh, "id", "left").withColumns({
        **{f: F.when(c("_revision").isNotNull(), F.coalesce(c(f"_u_{f}"), as_was[f])).otherwise(c(f)) for f in EDITABLE},
        "revision": F.coalesce("_revision", "revision")}).drop("_revision", *[f"_u_{f}" for f in EDITABLE])
    new_book = derive(rest.unionByName(made, allowMissingColumns=True))
    return new_book, done.select("seq", "op", "id", "status", "reason", "holder", "changed", "revision")
