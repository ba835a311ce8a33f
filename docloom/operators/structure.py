"""From elements to nodes to sections: kinds, links, runs and section assignment, without sequential state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.functions.text import file_name
from docloom.session import materialise

#: Keys that are hidden from a language model and from an embedder when a node is rendered.
HIDDEN_FROM_LLM = ("doc_id", "seq", "node_id", "parent_id", "coordinates", "detection_class_prob", "filename", "image_path")
HIDDEN_FROM_EMBEDDER = (*HIDDEN_FROM_LLM, "page_numbers", "languages", "summary")


#: Columns of elements that nodes keep as they are, where there are any.
KEPT = (
    "coordinates", "detection_class_prob", "category_depth", "is_continuation", "section", "sent_from", "sent_to", "subject",
    "languages", "link_texts", "link_urls", "emphasized_text_contents", "image_mime_type", "image_width", "extra",
)


def by_document(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(order or ("seq",)))


def kind() -> Column:
    """What an element is handled as: the first that fits of composite, table, image, text."""
    return (
        F.when(F.size("orig_elements") > 0, "composite")
        .when(F.col("category") == S.TABLE, "table")
        .when(F.coalesce("image_path", "image_base64").isNotNull(), "image")
        .otherwise("text")
    )


def to_nodes(elements: DataFrame, parents_there: bool = False) -> DataFrame:
    """Elements as nodes: a table's text is its HTML, page and name become lists, a parent must exist.

    Absent optional columns count as null. The parent is looked up by an equi-join on (doc_id, parent_id), which shuffles
    all texts; ``parents_there`` says that the reader names no others than there are, as ``text_elements`` does.
    """
    known = set(elements.columns)
    optional = {"text_as_html": "string", "page_name": "string", "filename": "string", "file_directory": "string", "image_path": "string", "image_base64": "string", "orig_elements": "array<struct<text:string,category:string>>", "page_number": "int"}
    for name, kind_name in optional.items():
        if name not in known:
            elements = elements.withColumn(name, F.lit(None).cast(kind_name))
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    html = F.nullif(F.col("text_as_html"), F.lit(""))
    nodes = elements.select(
        "doc_id",
        "seq",
        F.col("element_id").alias("node_id"),
        "parent_id",
        F.col("category").alias("type"),
        kind().alias("kind"),
        F.when(kind() == "table", F.coalesce(html, "text")).otherwise(F.col("text")).alias("text"),
        F.when(kind() == "table", html).alias("table_html"),
        F.when((kind() == "table") & html.isNotNull(), F.col("text")).alias("table_text"),
        listed("page_number").alias("page_numbers"),
        listed("page_name").alias("page_names"),
        file_name(F.col("file_directory"), F.col("filename")).alias("filename"),
        "image_path",
        "image_base64",
        "orig_elements",
        *[c for c in KEPT if c in known],
    )
    if parents_there:
        return nodes
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    return nodes.join(parents, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there")


def composite_parts(nodes: DataFrame) -> DataFrame:
    """The original elements of composites as nodes below the composite, linked to their neighbours in it.

    An element that is a composite itself, whose type has ``orig_elements`` again, is taken apart in turn.
    """
    level, out = nodes.select("doc_id", "node_id", "orig_elements"), None
    while True:
        fields = level.schema["orig_elements"].dataType.elementType.names
        parts = level.where(F.size("orig_elements") > 0).select("doc_id", F.col("node_id").alias("parent_id"), F.size("orig_elements").alias("n"), F.posexplode("orig_elements").alias("part", "o"))
        named = lambda at: F.concat_ws("/", "parent_id", at)
        parts = parts.withColumn("node_id", named(F.col("part")))
        is_table = F.col("o.category") == S.TABLE
        text = F.when(is_table, F.coalesce(F.nullif(F.col("o.text_as_html"), F.lit("")), "o.text")).otherwise(F.col("o.text")) if "text_as_html" in fields else F.col("o.text")
        made = parts.select(
            "doc_id",
            "node_id",
            "parent_id",
            "part",
            F.col("o.category").alias("type"),
            text.alias("text"),
            F.when(F.col("part") > 0, named(F.col("part") - 1)).alias("prev_id"),
            F.when(F.col("part") + 1 < F.col("n"), named(F.col("part") + 1)).alias("next_id"),
        )
        out = made if out is None else out.unionByName(made)
        if "orig_elements" not in fields:
            return out
        level = parts.select("doc_id", "node_id", F.col("o.orig_elements").alias("orig_elements"))


def linked(nodes: DataFrame, group: str = "doc_id", order: str = "seq", key: str = "node_id") -> DataFrame:
    """With the keys of both neighbours in reading order."""
    w = Window.partitionBy(group).orderBy(order)
    return nodes.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def child_counts(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    return nodes.where(F.col(parent).isNotNull()).groupBy("doc_id", parent).agg(F.count("*").alias("n_children"))


def without(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes less those removed; parents that are gone become null. Neighbours follow from what is left."""
    gone = materialise(removed.select("doc_id", "node_id").distinct().withColumn("gone", F.lit(True)), "gone-nodes")
    lost = gone.select("doc_id", F.col("node_id").alias("parent_id"))
    orphans = nodes.select("doc_id", "node_id", "parent_id").join(lost, ["doc_id", "parent_id"], "left_semi").select("doc_id", "node_id", F.lit(False).alias("gone"))
    # Only rows that change meet the texts, once.
    changed = gone.union(orphans).groupBy("doc_id", "node_id").agg(F.max("gone").alias("gone"))
    joined = nodes.join(materialise(changed, "changed-nodes"), ["doc_id", "node_id"], "left").where(~F.coalesce("gone", F.lit(False)))
    return joined.withColumn("parent_id", F.when(F.col("gone").isNull(), F.col("parent_id"))).drop("gone")


def visible(values: Column, hidden: tuple[str, ...]) -> Column:
    """A map rendered as lines ``key: value`` without the hidden keys."""
    shown = F.map_filter(values, lambda k, _: ~k.isin(*hidden))
    return F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def kept_keys(values: Column, keep: list[str]) -> Column:
    return F.map_filter(values, lambda k, _: k.isin(*keep))


def runs(nodes: DataFrame, kind_name: str, type_col: str = "type") -> DataFrame:
    """With ``run``: rows of one number form a maximal run of ``kind_name``, other rows are alone."""
    same = (F.col(type_col) == kind_name) & (F.lag(type_col).over(by_document()) == kind_name)
    return nodes.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("starts").over(by_document())).drop("starts")


def sections(nodes: DataFrame, least: int = 1024) -> DataFrame:
    """With ``target``, the node into which each goes, ``anchor`` and ``emitted``; no target: a dead letter.

    Headers, footers, images and tables pass through. A title is an anchor, and so is a node without a parent if it
    is longer than ``least`` or the first such. Any other node goes to its parent if that is an earlier anchor, else
    to the latest earlier node in the output that isn't an image or a table.
    """
    before = by_document().rowsBetween(Window.unboundedPreceding, -1)
    eligible = ~F.col("type").isin(S.HEADER, S.FOOTER, S.IMAGE, S.TABLE)
    candidate = eligible & ((F.col("type") == S.TITLE) | F.col("parent_id").isNull())
    first = F.count(F.when(F.col("candidate"), 1)).over(before) == 0
    anchor = F.col("candidate") & ((F.col("type") == S.TITLE) | F.col("long") | first)
    # Whether a text is long is known before the windows, so the places alone can be had without shuffling texts.
    marked = nodes.withColumn("long", F.length("text") > least).withColumn("eligible", eligible).withColumn("candidate", candidate).withColumn("anchor", anchor)
    marked = marked.withColumn("emitted", F.col("anchor") | ~F.col("eligible"))
    absorbs = F.col("emitted") & ~F.col("type").isin(S.TABLE, S.IMAGE)
    marked = marked.withColumn("latest", F.last(F.when(absorbs, F.col("node_id")), ignorenulls=True).over(before))
    anchors = marked.where("anchor").select("doc_id", F.col("node_id").alias("parent_id"), F.col("seq").alias("parent_seq"))
    joined = marked.join(anchors, ["doc_id", "parent_id"], "left")
    own_parent = F.when(F.col("parent_seq") < F.col("seq"), F.col("parent_id"))
    target = F.when(F.col("emitted"), F.col("node_id")).otherwise(F.coalesce(own_parent, "latest"))
    return joined.withColumn("target", target).drop("long", "eligible", "candidate", "latest", "parent_seq")
