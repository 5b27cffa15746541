"""Relational operators on the element table (doc_id, path, parent_path, pos, ord, depth, tag, ...).

Ancestry is read off the path (``/a[1]/b[2]``), so subtree work is an explode of a few path
prefixes and an equi-join, never a join on a path prefix.

Two tables of elements meet in sort-merge joins: how many elements a document holds is not known to the
planner, which takes millions of them for a table small enough to be broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import scalars as sc
from tabloom.functions.columns import col
from tabloom.operators import relational as rel
from tabloom.operators.ranking import global_row_number, running_share

KEY = ["doc_id", "path"]


def _segment(tags: list[str]) -> str:
    return "(" + "|".join(r"\Q" + t + r"\E" for t in tags) + r")\[\d+\]"


def prefixes(path: Column) -> Column:
    """All ancestor-or-self paths, root first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def _named(path: Column, name: str | None) -> Column:
    """The prefixes of ``path`` that lead to elements of that tag; all when it is not known."""
    return F.filter(prefixes(path), lambda p: p.rlike("/" + _segment([name]) + "$")) if name else prefixes(path)


def _side(df: DataFrame) -> DataFrame:
    """The other side of a join, never broadcast."""
    return df.hint("merge")


def plain(text: Column) -> Column:
    """Whitespace-normalised text; missing becomes empty."""
    return sc.collapse_whitespace(F.coalesce(text, F.lit("")))


# ---- search ------------------------------------------------------------------------------------------

def find(elements: DataFrame, tag: str | None = None, attribute: str | None = None, value: str | None = None, text: str | None = None) -> DataFrame:
    """All given conditions hold; value and text are case-insensitive containment."""
    tests = [F.lit(True)]
    if tag:
        tests.append(F.col("tag") == tag)
    if attribute:
        tests.append(F.map_contains_key("attrs", attribute))
    if value:
        tests.append(F.lower(F.coalesce(F.element_at("attrs", attribute), F.lit(""))).contains(value.lower()))
    if text:
        tests.append(F.lower("content_text").contains(text.lower()))
    return elements.where(reduce(lambda a, b: a & b, tests))


_NAME = r"[^\s/\[\]@=!|'\"*.:{}()]+"
_STEP = re.compile(rf"(//|/)?(?:(\.\.)|(\.)|(\*|(?:{{[^}}]*}})?{_NAME}))((?:\[[^\]]*\])*)")
_TEST = re.compile(
    rf"\[\s*(?:(?P<index>\d+)|last\(\)\s*(?:-\s*(?P<back>\d+))?|@(?P<attr>{_NAME})(?:\s*(?P<op>!?=)\s*(?P<q>['\"])(?P<value>.*?)(?P=q))?"
    rf"|(?P<child>\.|{_NAME})(?:\s*(?P<cop>!?=)\s*(?P<cq>['\"])(?P<cvalue>.*?)(?P=cq))?)\s*\]")


def parse_path(path: str) -> list[tuple[str, str, list[dict]]]:
    """(axis, name, tests) per step; raises ``ValueError`` on anything that is not supported."""
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m.end() == at or (at > 0 and not m[1]) or (at == 0 and m[1]):
            raise ValueError(f"path {path!r} is not supported from {path[at:]!r} on")
        tests, inside = [], 0
        while inside < len(m[5]):
            t = _TEST.match(m[5], inside)
            if not t:
                raise ValueError(f"predicate {m[5][inside:]!r} is not supported")
            tests.append(t.groupdict())
            inside = t.end()
        steps.append(("descendant" if m[1] == "//" else "child", m[2] or m[3] or m[4], tests))
        at = m.end()
    return steps


def _local(name: str) -> str | None:
    """The tag that a step's name stands for; none for ``*``, ``.`` and ``..``."""
    return None if name in ("*", ".", "..") or name.endswith("}*") else name.rpartition("}")[2]


def _text_below(elements: DataFrame, name: str | None = None) -> DataFrame:
    """(doc_id, path, _all): all text of an element (of that tag) as it stands, tails of its descendants included."""
    own = elements.where("coalesce(text, '') <> '' OR coalesce(tail, '') <> ''").select("doc_id", "path", "ord", "text", "tail", "last_ord")
    own = own.select("*", F.explode(_named(F.col("path"), name)).alias("_up"))
    # A tail stands behind its whole subtree, and belongs to the ancestors only.
    start = F.struct(F.col("ord").cast("double").alias("at"), F.lit(0).alias("deep"), F.coalesce("text", F.lit("")).alias("s"))
    end = F.struct((F.col("last_ord") + 0.5).cast("double").alias("at"), (-F.length("path")).alias("deep"), F.when(F.col("_up") != F.col("path"), F.coalesce("tail", F.lit(""))).otherwise(F.lit("")).alias("s"))
    pieces = own.select("doc_id", F.col("_up").alias("path"), F.explode(F.array(start, end)).alias("p")).where(F.col("p.s") != "")
    return pieces.groupBy("doc_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("_all"))


def _holds(elements: DataFrame, found: DataFrame, test: dict, name: str | None = None) -> DataFrame:
    """Rows of ``found``, all of the tag ``name`` if given, that meet one predicate."""
    compare = lambda column, op, value: (column == value) if op == "=" else (column != value)
    if test["attr"]:
        here = F.map_contains_key("attrs", test["attr"])
        return found.where(here & compare(F.element_at("attrs", test["attr"]), test["op"], test["value"]) if test["op"] else here)
    if test["child"] == ".":
        if not test["cop"]:
            raise ValueError("a predicate on the element itself needs a value")
        texts = found.join(_side(_text_below(elements, name)), KEY, "left")
        return texts.where(compare(F.coalesce("_all", F.lit("")), test["cop"], test["cvalue"])).drop("_all")
    if test["child"]:
        kids = elements.where(F.col("tag") == test["child"]).select("doc_id", "path", "parent_path")
        if test["cop"]:
            kids = kids.join(_side(_text_below(elements, test["child"])), KEY, "left")
            kids = kids.where(compare(F.coalesce("_all", F.lit("")), test["cop"], test["cvalue"]))
        return found.join(_side(kids.select("doc_id", F.col("parent_path").alias("path")).distinct()), KEY, "left_semi")
    index = F.regexp_extract("path", r"\[(\d+)\]$", 1).cast("int")
    if test["index"]:
        return found.where(index == int(test["index"]))
    alike = elements.where(F.col("tag") == name) if name else elements
    sizes = alike.groupBy("doc_id", "parent_path", "tag").agg(F.count(F.lit(1)).alias("_n"))
    return found.join(_side(sizes), ["doc_id", "parent_path", "tag"]).where(index == F.col("_n") - int(test["back"] or 0)).drop("_n")


def match_path(elements: DataFrame, path: str) -> DataFrame:
    """Elements that a path from the root element leads to, each once.

    Steps are names (``{namespace}name`` too), ``*``, ``.`` and ``..``, joined by ``/`` and ``//``; predicates
    are ``[@a]``, ``[@a='v']``, ``[tag]``, ``[tag='v']``, ``[.='v']`` (``!=`` as well), ``[n]``, ``[last()]`` and
    ``[last()-n]``, where positions count among siblings of the same tag. Every step is one equi-join.
    """
    found = elements.where("depth = 0")
    for axis, name, tests in parse_path(path):
        here = found.select("doc_id", F.col("path").alias("_from"))
        if name == ".." or name == ".":
            if axis == "descendant":
                raise ValueError(f"// before {name} is not supported")
            if name == "..":
                above = found.select("doc_id", F.col("parent_path").alias("path")).distinct()
                found = elements.join(_side(above), KEY, "left_semi")
        else:
            space, _, local = name[1:].partition("}") if name.startswith("{") else (None, "", name)
            wanted = elements if local == "*" else elements.where(F.col("tag") == local)
            wanted = wanted if space is None else wanted.where(F.col("namespace") == space)
            if axis == "child":
                found = wanted.join(_side(here.withColumnRenamed("_from", "parent_path")), ["doc_id", "parent_path"], "left_semi")
            else:
                up = wanted.select(*KEY, F.explode(prefixes(F.col("parent_path"))).alias("_from"))
                below = up.join(_side(here), ["doc_id", "_from"], "left_semi").select(*KEY).distinct()
                found = wanted.join(_side(below), KEY, "left_semi")
        for test in tests:
            found = _holds(elements, found, test, _local(name))
        found = found.select(*elements.columns)
    return found


def select_path(elements: DataFrame, steps: str, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of the subtrees below every element matched by the path (and by an attribute of it)."""
    hits = match_path(elements, steps)
    if attribute:
        hits = hits.where(F.element_at("attrs", attribute) == value if value is not None else F.map_contains_key("attrs", attribute))
    hits = hits.select("doc_id", F.col("path").alias("match_path"))
    last = parse_path(steps)
    exploded = elements.withColumn("match_path", F.explode(_named(F.col("path"), _local(last[-1][1]) if last else None)))
    return exploded.join(_side(hits), ["doc_id", "match_path"])


def xpath_values(documents: DataFrame, expression: str, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Text values of any XPath 1.0 expression, by Spark's own evaluator."""
    return documents.select(key, F.posexplode(F.xpath(col(xml), F.lit(expression)))).withColumnsRenamed({"pos": "position", "col": "value"})


# ---- records ---------------------------------------------------------------------------------------------

def _below_records(elements: DataFrame, record_tag: str) -> DataFrame:
    """Every element once per enclosing record, with its index-free path relative to the record."""
    own = F.filter(prefixes(F.col("path")), lambda p: p.rlike("/" + _segment([record_tag]) + "$"))
    rows = elements.withColumn("record_path", F.explode(own))
    rest = F.expr("substring(path, length(record_path) + 2)")
    return rows.withColumn("field", F.regexp_replace(rest, r"\[\d+\]", ""))


def record_fields(elements: DataFrame, record_tag: str) -> DataFrame:
    below = _below_records(elements, record_tag)
    prefix = F.when(F.col("field") == "", "").otherwise(F.concat("field", F.lit("/")))
    names = F.concat(
        F.when(F.col("field") == "", F.array().cast("array<string>")).otherwise(F.array("field")),
        F.transform(F.map_keys("attrs"), lambda k: F.concat(prefix, F.lit("@"), k)),
    )
    return below.select(F.explode(names).alias("field")).distinct()


def flatten_records(elements: DataFrame, record_tag: str, fields: list[str]) -> DataFrame:
    """(doc_id, record_number, one column per field); several values are joined by `` | ``."""
    below = _below_records(elements, record_tag)
    aggs = [F.min("ord").alias("_ord")]
    for i, f in enumerate(fields):
        head, _, attr = f.rpartition("@")
        value = F.element_at("attrs", attr) if attr and "@" in f else F.col("content_text")
        place = head.rstrip("/") if "@" in f else f
        hit = F.when((F.col("field") == place) & (F.coalesce(value, F.lit("")) != ""), F.struct("ord", value.alias("v")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["v"]), " | ")
        aggs.append(joined.alias(f"f{i}"))
    records = below.groupBy("doc_id", "record_path").agg(*aggs)
    numbered = records.withColumn("record_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("_ord")))
    return numbered.select("doc_id", "record_number", *[F.col(f"f{i}").alias(f) for i, f in enumerate(fields)])


def default_record_tag(elements: DataFrame) -> DataFrame:
    """Most frequent, then shallowest, then first by name."""
    return elements.groupBy("tag").agg(F.count(F.lit(1)).alias("count"), F.min("depth").alias("depth")).orderBy(F.desc("count"), "depth", "tag").limit(1)


def tag_summary(elements: DataFrame) -> DataFrame:
    return elements.groupBy("tag").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("with_text"))


def structure_counts(elements: DataFrame) -> DataFrame:
    return elements.agg(
        F.count(F.lit(1)).alias("elements"), F.sum(F.size("attrs")).alias("attributes"),
        F.count_distinct("tag").alias("tags"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("with_text"),
    )


# ---- text cleaning ---------------------------------------------------------------------------------------

def _cased(c: Column, case: str | None) -> Column:
    return sc.change_case(c, case) if case else c


def clean_text(elements: DataFrame, whitespace: bool = True, case: str | None = None) -> DataFrame:
    """Whitespace and case on text and tail, case on attributes; ``changes`` counts altered values."""
    def fix(name):
        c = F.col(name)
        return _cased(sc.collapse_whitespace(c) if whitespace else c, case)

    attrs = F.transform_values("attrs", lambda _, v: _cased(v, case))
    changed = lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)
    moved = F.size(F.filter(F.map_entries("attrs"), lambda e: ~_cased(e["value"], case).eqNullSafe(e["value"])))
    return elements.withColumns({
        "changes": changed(fix("text"), F.col("text")) + changed(fix("tail"), F.col("tail")) + moved,
        "text": fix("text"), "tail": fix("tail"), "attrs": attrs,
    })


def refresh_content(elements: DataFrame) -> DataFrame:
    """Recompute ``content_text`` after text edits: trimmed texts and tails below, in document order."""
    own = elements.select("doc_id", "path", "ord", "last_ord", "depth", *[F.coalesce(F.trim(sc.collapse_whitespace(c)), F.lit("")).alias(c) for c in ("text", "tail")])
    up = own.where("text <> '' OR tail <> ''").withColumn("_up", F.explode(prefixes(F.col("path"))))
    start = F.struct("ord", F.lit(0).alias("close"), F.lit(0).alias("d"), F.col("text").alias("t"))
    # A tail stands behind its whole subtree, and belongs to the ancestors only.
    end = F.struct(F.col("last_ord").alias("ord"), F.lit(1).alias("close"), (-F.col("depth")).alias("d"), F.when((F.col("_up") != F.col("path")) & (F.col("depth") > 0), F.col("tail")).otherwise("").alias("t"))
    events = up.select("doc_id", F.col("_up").alias("path"), F.explode(F.array(start, end)).alias("e")).where("e.t <> ''")
    content = events.groupBy("doc_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), " ").alias("_c"))
    return elements.drop("content_text").join(_side(content), KEY, "left").withColumn("content_text", F.coalesce("_c", F.lit(""))).drop("_c")


def remove_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Without the subtrees of the tags; the path alone tells, so this is a filter. The root must stay."""
    return elements.where(~F.col("path").rlike("/" + _segment(tags)))


def removed_tag_count(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Top-most hits only."""
    top = F.col("path").rlike("/" + _segment(tags) + "$") & ~F.col("parent_path").rlike("/" + _segment(tags))
    return elements.agg(F.count_if(top).alias("removed"))


def check_root_kept(elements: DataFrame, tags: list[str]) -> None:
    if elements.where((F.col("depth") == 0) & F.col("tag").isin(tags)).limit(1).count():
        raise ValueError("the root element cannot be removed")


def remove_attributes(elements: DataFrame, names: list[str]) -> DataFrame:
    return elements.withColumn("attrs", F.map_filter("attrs", lambda k, _: ~k.isin(names)))


# ---- values ------------------------------------------------------------------------------------------------

def fill_empty(elements: DataFrame, tags: list[str], value: str) -> DataFrame:
    empty = F.col("tag").isin(tags) & (F.coalesce("content_text", F.lit("")) == "")
    return elements.withColumns({"text": F.when(empty, F.lit(value)).otherwise(F.col("text")), "content_text": F.when(empty, F.lit(value)).otherwise(F.col("content_text"))})


def _rewrite(elements: DataFrame, tags: list[str], new: Column) -> tuple[DataFrame, DataFrame]:
    chosen = F.col("tag").isin(tags) & (plain(F.col("text")) != "")
    marked = elements.withColumn("_new", F.when(chosen, new)).withColumn("_chosen", chosen)
    failures = marked.where("_chosen AND _new IS NULL").select("doc_id", "path", "tag", F.trim("text").alias("value"))
    return marked.withColumn("text", F.coalesce("_new", "text")).drop("_new", "_chosen"), failures


def reformat_dates(elements: DataFrame, tags: list[str], source_format: str, target_format: str) -> tuple[DataFrame, DataFrame]:
    """(elements, failures)."""
    return _rewrite(elements, tags, sc.reformat_date(F.trim("text"), source_format, target_format))


def quantize_numbers(elements: DataFrame, tags: list[str], places: int) -> tuple[DataFrame, DataFrame]:
    return _rewrite(elements, tags, sc.quantize(F.trim("text"), places))


# ---- incomplete, empty and duplicate elements ------------------------------------------------------------------

def _drop_subtrees(elements: DataFrame, removed: DataFrame, tag: str | None = None) -> DataFrame:
    """Without the subtrees of ``removed`` (doc_id, path), all of the tag ``tag`` if given."""
    gone = removed.select("doc_id", F.col("path").alias("_top"))
    tops = elements.select(*KEY, F.explode(_named(F.col("path"), tag)).alias("_top"))
    inside = tops.join(_side(gone), ["doc_id", "_top"], "left_semi").select(*KEY).distinct()
    return elements.join(_side(inside), KEY, "left_anti")


def _first_child_text(elements: DataFrame, name: str) -> DataFrame:
    """(doc_id, path of the parent, content of its first direct child of that tag)."""
    kids = elements.where(F.col("tag") == name)
    return kids.groupBy("doc_id", F.col("parent_path").alias("path")).agg(F.min_by("content_text", "pos").alias("_value"))


def _required_value(elements: DataFrame, tag: str, field: str) -> DataFrame:
    records = elements.where((F.col("tag") == tag) & (F.col("depth") > 0))
    if field.startswith("@"):
        return records.withColumn("_value", F.element_at("attrs", field[1:]))
    return records.join(_side(_first_child_text(elements, field)), KEY, "left")


def drop_incomplete(elements: DataFrame, record_tag: str, field: str) -> DataFrame:
    """Without records whose attribute (``@name``) or first direct child is blank."""
    bad = _required_value(elements, record_tag, field).where(plain(F.col("_value")) == "")
    return _drop_subtrees(elements, bad, record_tag)


def drop_empty(elements: DataFrame) -> DataFrame:
    """Bottom-up removal of leaves without attributes and text, without a loop: an element stays
    exactly when something below it, or the element itself, has an attribute or text."""
    solid = elements.where((F.size("attrs") > 0) | (plain(F.col("text")) != "") | (F.col("depth") == 0))
    kept = solid.select("doc_id", F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    return elements.join(_side(kept), KEY, "left_semi")


def dedupe_exact(elements: DataFrame) -> DataFrame:
    """Keep the first of equal sibling subtrees, children deduplicated before their parents.

    One pass per tree level, deepest first (tree depth bounds the loop); a level's signatures
    come from the signatures of the level below.
    """
    depth = elements.agg(F.max("depth")).first()[0]
    attrs = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\u001f")
    own = elements.select("doc_id", "path", "parent_path", "pos", "depth",
                          F.concat_ws("\u001e", "namespace", "tag", attrs, plain(F.col("text"))).alias("own"), plain(F.col("tail")).alias("tail"))
    below, removed = None, None
    for level in range(depth or 0, 0, -1):
        here = own.where(F.col("depth") == level)
        if below is not None:
            kids = below.groupBy("doc_id", F.col("parent_path").alias("path")).agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sig", "tail"))), lambda s: F.concat(s["sig"], F.lit("\u001f"), s["tail"])), "\u001e").alias("kids"))
            here = here.join(_side(kids), KEY, "left")
        else:
            here = here.withColumn("kids", F.lit(""))
        signed = here.withColumn("sig", F.sha2(F.concat_ws("\u001d", "own", F.coalesce("kids", F.lit(""))), 256))
        marked = signed.withColumn("_keep", F.min("pos").over(Window.partitionBy("doc_id", "parent_path", "sig")))
        below = marked.where("pos = _keep").select("doc_id", "path", "parent_path", "pos", "sig", "tail")
        gone = marked.where("pos > _keep").select(*KEY)
        removed = gone if removed is None else removed.unionByName(gone)
    return elements if removed is None else _drop_subtrees(elements, removed)


def dedupe_by_key(elements: DataFrame, tag: str, key: str) -> DataFrame:
    """Keep the first sibling of ``tag`` per key value (``@attr`` or direct child); blank keys never match."""
    keyed = _required_value(elements, tag, key).withColumn("_value", plain(F.col("_value"))).where("_value <> ''")
    gone = keyed.withColumn("_keep", F.min("pos").over(Window.partitionBy("doc_id", "parent_path", "_value"))).where("pos > _keep")
    return _drop_subtrees(elements, gone, tag)


# ---- renaming and renumbering --------------------------------------------------------------------------------

def rename_tag(elements: DataFrame, old: str, new: str) -> DataFrame:
    """Every such tag; paths follow and are renumbered. The namespace stays."""
    swap = lambda c: F.regexp_replace(c, r"/\Q" + old + r"\E\[", "/" + new + "[")
    marked = elements.withColumns({"tag": F.when(F.col("tag") == old, new).otherwise(F.col("tag"))})
    return renumber(marked.withColumns({"_old": F.col("path"), "_oldp": F.col("parent_path")}), swap)


def renumber(elements: DataFrame, swap=None) -> DataFrame:
    """Rewrite sibling indices in paths after elements were removed or renamed."""
    work = elements if swap else elements.withColumns({"_old": F.col("path"), "_oldp": F.col("parent_path")})
    w = Window.partitionBy("doc_id", "_oldp", "tag").orderBy("ord")
    own = work.select("doc_id", "_old", F.concat("tag", F.lit("["), F.row_number().over(w).cast("string"), F.lit("]")).alias("_seg"))
    up = work.select("doc_id", F.col("_old").alias("_self"), F.posexplode(prefixes(F.col("_old"))).alias("_lvl", "_old"))
    joined = up.join(_side(own), ["doc_id", "_old"]).groupBy("doc_id", "_self").agg(F.array_sort(F.collect_list(F.struct("_lvl", "_seg"))).alias("_segs"))
    names = F.transform("_segs", lambda s: s["_seg"])
    whole = F.concat(F.lit("/"), F.array_join(names, "/"))
    parent = F.when(F.size("_segs") == 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), F.size("_segs") - 1), "/")))
    paths = joined.select("doc_id", F.col("_self").alias("_old"), whole.alias("path"), parent.alias("parent_path"))
    return work.drop("path", "parent_path").join(_side(paths), ["doc_id", "_old"]).drop("_old", "_oldp").select(*elements.drop("_old", "_oldp").columns)


def rename_attribute(elements: DataFrame, old: str, new: str) -> DataFrame:
    """Fails when an element already has the new name next to the old one."""
    if old == new:
        return elements
    if elements.where(F.map_contains_key("attrs", old) & F.map_contains_key("attrs", new)).limit(1).count():
        raise ValueError(f"cannot rename attribute {old!r}: {new!r} already exists")
    return elements.withColumn("attrs", F.transform_keys("attrs", lambda k, _: F.when(k == old, F.lit(new)).otherwise(k)))


# ---- documents ---------------------------------------------------------------------------------------------------

def combine(elements: DataFrame, doc_order: str = "doc_id", out: str = "combined", **options) -> DataFrame:
    """All documents under one root. Root tag, attributes and text must agree.

    Top-level children are renumbered by adding, per tag, the number of such children in earlier
    documents: a running sum over documents, not a window over the combined document. ``options`` go
    to ``running_share``.
    """
    roots = elements.where("depth = 0")
    shapes = roots.select("namespace", "tag", F.array_sort(F.map_entries("attrs")).alias("a"), plain(F.col("text")).alias("t")).distinct()
    if len(shapes.limit(2).collect()) > 1:
        raise ValueError("documents have different roots and cannot be combined")
    first_doc = roots.agg(F.min(doc_order)).first()[0]
    # Documents are numbered first: ids may be texts, and running sums need an order that can be cut into slices.
    numbers = _side(global_row_number(roots.select(F.col(doc_order).alias("_doc")).distinct(), [F.col("_doc")], "_num"))
    kids = elements.where("depth = 1").groupBy("tag", F.col(doc_order).alias("_doc")).agg(F.count(F.lit(1)).alias("_n")).join(numbers, "_doc")
    offsets = running_share(kids, ["tag"], "_num", "_n", "_earlier", **options).select(F.col("tag").alias("_top_tag"), "_doc", F.col("_earlier"))
    sizes = elements.groupBy(F.col(doc_order).alias("_doc")).agg(F.max("ord").alias("_size"), F.count_if(F.col("depth") == 1).alias("_kids")).withColumn("_all", F.lit(1)).join(numbers, "_doc")
    starts = running_share(running_share(sizes, ["_all"], "_num", "_size", "_ord0", **options), ["_all"], "_num", "_kids", "_pos0", **options).select("_doc", "_ord0", "_pos0")
    top = F.regexp_extract("path", r"^/[^/]+/([^/\[]+)\[", 1)
    body = elements.where("depth > 0").withColumns({"_top_tag": top, "_doc": F.col(doc_order)}).join(_side(offsets), ["_top_tag", "_doc"]).join(_side(starts), "_doc")
    index = F.regexp_extract("path", r"^/[^/]+/[^/\[]+\[(\d+)\]", 1).cast("bigint") + F.col("_earlier")
    head, rest = F.regexp_extract("path", r"^(/[^/]+/[^/\[]+\[)", 1), F.regexp_extract("path", r"^/[^/]+/[^/\[]+\[\d+(\].*)$", 1)
    new_path = F.concat(head, index.cast("string"), rest)
    cut = F.regexp_replace("path", r"/[^/]+$", "")
    body = body.withColumns({"path": new_path, "ord": F.col("ord") + F.col("_ord0"), "last_ord": F.col("last_ord") + F.col("_ord0"),
                             "pos": F.when(F.col("depth") == 1, F.col("pos") + F.col("_pos0")).otherwise(F.col("pos"))})
    body = body.withColumn("parent_path", cut)
    names = [c for c in elements.columns if c != "doc_id"]
    root = elements.where((F.col("depth") == 0) & (F.col(doc_order) == F.lit(first_doc)))
    return root.select(F.lit(out).alias("doc_id"), *names).unionByName(body.select(F.lit(out).alias("doc_id"), *names))


def split(elements: DataFrame, child_tag: str, size: int) -> DataFrame:
    """Elements with a ``part``: chosen top-level children in chunks, everything else in every part."""
    top = r"^/[^/]+/" + r"\Q" + child_tag + r"\E\[(\d+)\]"
    index = F.regexp_extract("path", top, 1)
    chosen = elements.where(F.col("path").rlike(top)).withColumn("part", F.floor((index.cast("bigint") - 1) / size) + 1)
    parts = chosen.where("depth = 1").groupBy("doc_id").agg(F.max("part").alias("_parts"))
    others = elements.where(~F.col("path").rlike(top)).join(parts, "doc_id").withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), "_parts"))).drop("_parts")
    return chosen.unionByName(others)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Added, removed and changed paths between two element tables of the same documents."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    row = lambda df: df.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "path").alias("path"),
                               F.concat_ws("|", "tag", attrs, F.trim(F.coalesce("text", F.lit("")))).alias("value"))
    return rel.compare_by_key(row(left), _side(row(right)), "path", "value")
