"""Rules of sections, media and their findings, from the tag stream with depths by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import count_of, has_text
from quill.operators.findings import finding
from quill.operators.structure import INLINE, LISTS, SLOTS


def with_frames(tags: DataFrame, name: str, id_column: str = "doc_id") -> DataFrame:
    """Tags with `depth`, how many elements of `name` are open at a tag (its own opener counted, its own close not yet), and `frame`, the start of the innermost one's opener. Depth never falls below 0; stray closes are marked `stray`."""
    own = Window.partitionBy(id_column).orderBy("start")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    mine = (F.col("name") == name) & ~F.col("is_self")
    move = F.when(mine & F.col("is_close"), -1).when(mine, 1).otherwise(0)
    rows = tags.withColumn("s", F.sum(move).over(upto))
    rows = rows.withColumn("after", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    before = F.coalesce(F.lag("after").over(own), F.lit(0))
    rows = rows.withColumns({"stray": mine & F.col("is_close") & (before == 0), "depth": F.when(mine & F.col("is_close"), before).otherwise(F.col("after"))})
    # The latest opener at this depth is the one that is open.
    at = Window.partitionBy(id_column, "depth").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    opener = F.last(F.when(mine & ~F.col("is_close"), F.col("start")), True).over(at)
    return rows.withColumn("frame", F.when(F.col("depth") > 0, opener)).drop("s", "after")


def check_media(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Findings on mediaobject, imageobject and imagedata: outside a mediaobject, a mediaobject without them, imagedata without fileref, self-closed mediaobjects, stray closes. A mediaobject is judged where it closes."""
    # Only these three are judged, counted or open anything here.
    rows = with_frames(tags.filter(F.col("name").isin("mediaobject", "imageobject", "imagedata")), "mediaobject", id_column)
    opens = ~F.col("is_close")
    is_ = lambda n: F.col("name") == n
    outside = opens & (F.col("depth") == 0)
    code = (
        F.when(is_("mediaobject") & F.col("is_self"), "media.self_closed")
        .when(F.col("stray"), "media.stray_close")
        .when(outside & F.col("name").isin("imageobject", "imagedata"), "media.outside")
        .when(is_("imagedata") & opens & ~F.col("attrs").rlike(r"(?iU)\bfileref\s*="), "media.no_fileref")
    )
    fix = F.when((F.col("code") == "media.outside") & is_("imageobject"), "wrap-in-mediaobject")
    single = finding(rows.withColumn("code", code).filter("code is not null"), id_column, F.col("code"), F.concat(F.lit("<"), "name", F.lit("> "), F.split_part("code", F.lit("."), F.lit(2))), F.col("name"), fix, el_start=F.col("start"))
    frames = rows.filter((F.col("depth") > 0) & F.col("frame").isNotNull()).groupBy(id_column, "frame").agg(
        F.count_if(is_("imageobject") & opens).alias("objects"), F.count_if(is_("imagedata") & opens).alias("data"),
        F.max(is_("mediaobject") & F.col("is_close")).alias("closed"), F.min(F.when(is_("mediaobject") & opens, F.col("line"))).alias("line"),
    )
    lacks = F.when(F.col("objects") == 0, "media.no_imageobject").when(F.col("data") == 0, "media.no_imagedata")
    judged = frames.withColumn("code", lacks).filter("closed and code is not null").withColumn("start", F.col("frame"))
    return single.unionByName(finding(judged, id_column, F.col("code"), F.concat(F.lit("<mediaobject> "), F.split_part("code", F.lit("."), F.lit(2))), F.lit("mediaobject")))


def check_sections(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Findings on each section that closes: no title among its own children, a title that is not its first child, several titles; and once for each section the first own content after a child section."""
    # A section's opener comes a second time one level up, where it tells the section around of a child.
    twice = F.explode(F.when((F.col("name") == "section") & ~F.col("is_close") & ~F.col("is_self") & (F.col("depth") > 1), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("below")
    rows = with_frames(tags, "section", id_column).filter("depth > 0 and frame is not null").select("*", twice).withColumn("depth", F.col("depth") - F.col("below").cast("int"))
    around = F.last(F.when(~F.col("below"), F.col("frame")), True).over(Window.partitionBy(id_column, "depth").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("frame", F.when(F.col("below"), around).otherwise(F.col("frame"))).filter("frame is not null")
    # Depth among all elements tells children from deeper ones: an element is a child where nothing but sections is open around it.
    others = Window.partitionBy(id_column, "frame").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    move = F.when((F.col("name") == "section") | F.col("is_self"), 0).when(F.col("is_close"), -1).otherwise(1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(move).over(others), F.lit(0)))
    opens = ~F.col("is_close")
    is_child = opens & (F.col("inner") == 0) & (F.col("name") != "section")
    first_section = F.min(F.when(F.col("below"), F.col("start"))).over(Window.partitionBy(id_column, "frame"))
    rows = rows.withColumns({"first_section": first_section, "child": is_child})
    frames = rows.groupBy(id_column, "frame").agg(
        F.max((F.col("name") == "section") & F.col("is_close")).alias("closed"),
        F.count_if(F.col("child") & (F.col("name") == "title")).alias("titles"),
        F.min_by(F.when(F.col("child"), F.col("name")), F.when(F.col("child"), F.col("start"))).alias("first"),
        F.min(F.when(F.col("child") & (F.col("start") > F.col("first_section")), F.struct("start", "line", "name"))).alias("late"),
        F.min(F.when((F.col("name") == "section") & opens, F.col("line"))).alias("line"),
        F.min("first_section").alias("first_section"),
    )
    title = F.when(F.col("titles") == 0, "section.no_title").when(F.col("titles") > 1, "section.titles").when(F.col("first") != "title", "section.title_not_first")
    titled = frames.withColumn("code", title).filter("closed and code is not null").withColumn("start", F.col("frame"))
    late = frames.filter("late is not null").select(id_column, F.col("late.line").alias("line"), F.col("late.start").alias("start"), F.col("late.name").alias("name"), F.col("frame").alias("section_start"), "first_section")
    out = finding(titled, id_column, F.col("code"), F.concat(F.lit("<section> "), F.split_part("code", F.lit("."), F.lit(2))), F.lit("section"))
    spec = {"el_start": F.col("start"), "section_start": F.col("section_start"), "first_sub": F.col("first_section")}
    return out.unionByName(finding(late, id_column, F.lit("section.late_content"), F.concat(F.lit("<"), "name", F.lit("> after a child section")), F.col("name"), F.lit("content-after-subsection"), **spec))


#: element -> what may open directly inside it; other elements allow anything.
ALLOWED = {**SLOTS, **{name: ["listitem"] for name in LISTS}, "para": INLINE}


def parents(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Opening tags with the name of the innermost element open around them, for texts whose tags of ALLOWED and their children nest. Openers at depth d have as parent the latest opener at depth d - 1."""
    own = Window.partitionBy(id_column).orderBy("start")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = tags.filter("not is_self or not is_close")
    rows = rows.withColumn("s", F.sum(F.when(F.col("is_self"), 0).when(F.col("is_close"), -1).otherwise(1)).over(upto))
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    openers = rows.filter("not is_close").withColumn("depth", F.col("depth") + F.col("is_self").cast("int"))
    # As-of within (document, depth): the latest opener one level up. Each opener comes at its depth, and one level down as what may be around.
    line, none = F.col("line").cast("long"), F.lit(None).cast("string")
    at = lambda depth, line, name, p: F.struct(depth.alias("depth"), line.alias("line"), name.alias("name"), p.alias("p"))
    both = openers.select(id_column, "start", F.explode(F.array(at(F.col("depth"), line, F.col("name"), none), F.when(~F.col("is_self"), at(F.col("depth") + 1, F.lit(None).cast("long"), none, F.col("name"))))).alias("o"))
    both = both.filter("o is not null").select(id_column, "o.depth", "start", "o.line", "o.name", "o.p")
    latest = F.last("p", True).over(Window.partitionBy(id_column, "depth").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("parent", latest).filter("name is not null").drop("p")


def check_placement(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Findings for elements that sit directly inside one that does not allow them."""
    rules = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.try_element_at(rules, F.col("parent"))
    rows = parents(tags, id_column).filter(allowed.isNotNull() & ~F.array_contains(allowed, F.col("name")))
    prefix = F.when(F.col("parent") == "para", "para").when(F.col("parent").endswith("list"), "list").otherwise("table")
    return finding(rows, id_column, F.concat(prefix, F.lit(".misplaced_child")), F.concat(F.lit("<"), "name", F.lit("> directly inside <"), "parent", F.lit(">")), F.col("name"))


def check_loose_text(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Findings for text directly before a tag and directly inside an element that allows elements only: after the opener or close of a child of a container."""
    own = Window.partitionBy(id_column).orderBy("start")
    rows = parents(tags, id_column).select(id_column, "start", F.col("parent").alias("opener_parent"))
    joined = tags.join(rows, [id_column, "start"], "left")
    previous = {"pn": F.lag("name").over(own), "pc": F.lag("is_close").over(own), "pp": F.lag("opener_parent").over(own)}
    joined = joined.withColumns(previous)
    inside = F.when(~F.col("pc"), F.col("pn")).otherwise(F.when(F.col("is_close"), F.col("name")).otherwise(F.col("opener_parent")))
    containers = [k for k in ALLOWED if k != "para"]
    bad = inside.isin(containers) & has_text(F.col("gap"))
    found = joined.filter(bad).withColumn("inside", inside)
    prefix = F.when(F.col("inside").endswith("list"), "list").otherwise("table")
    return finding(found.withColumn("line", F.col("line") - count_of(F.col("gap"), "\n")), id_column, F.concat(prefix, F.lit(".text_in_container")), F.concat(F.lit("text directly inside <"), "inside", F.lit(">")), F.col("inside"))
