"""Structure of documents: packing of lines, transcripts, evidence texts, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest group and least length of a last group, in characters; a silence of this many ms starts a turn (fixed values).
PACK, TAIL, SILENCE_MS = 2000, 500, 2000
#: A transcript line: [mm:ss] speaker: text.
TRANSCRIPT = r"^\[(\d+):(\d\d)\] (\w+): (.*)$"


def pack_lines(lines: Column, limit: int = PACK, tail: int = TAIL) -> Column:
    """An array of lines packed in order into texts of at most ``limit`` characters; one longer line stands alone.

    A last text shorter than ``tail`` joins the one before. A fold over the
    array, as each decision depends on the group so far. Null or empty gives none.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, line: Column) -> Column:
        fits = acc["now"].isNull() | (F.length(acc["now"]) + F.length(line) + 1 <= limit)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat_ws("\n", acc["now"], line).alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), line.alias("now")))

    def finish(acc: Column) -> Column:
        short = (F.length(acc["now"]) < tail) & (F.size(acc["done"]) > 0)
        last = F.when(short, F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.concat_ws("\n", F.get(acc["done"], F.size(acc["done"]) - 1), acc["now"]))))
        return F.when(acc["now"].isNull(), acc["done"]).otherwise(F.coalesce(last, F.concat(acc["done"], F.array(acc["now"]))))

    return F.aggregate(F.coalesce(lines, F.array().cast("array<string>")), start, step, finish)


def transcript(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, start_ms, speaker, said) of the lines that are transcript lines."""
    part = lambda k: F.regexp_extract("line", TRANSCRIPT, k)
    return lines.where(F.col("line").rlike(TRANSCRIPT)).select(key, "line_no", ((part(1).cast("bigint") * 60 + part(2).cast("bigint")) * 1000).alias("start_ms"), part(3).alias("speaker"), part(4).alias("said"))


def turns(spoken: DataFrame, key: str, silence_ms: int = SILENCE_MS) -> DataFrame:
    """(key, turn, speaker, n, start_ms, end_ms, said): lines in a row of one speaker without a silence of ``silence_ms``."""
    w = Window.partitionBy(key).orderBy("start_ms", "line_no")
    fresh = F.when((F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start_ms") - F.lag("start_ms").over(w) < silence_ms), 0).otherwise(1)
    numbered = spoken.withColumn("_fresh", fresh).withColumn("turn", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "line_no", "said"))), lambda x: x["said"]), " ")
    return numbered.groupBy(key, "turn").agg(F.first("speaker").alias("speaker"), F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("start_ms").alias("end_ms"), said.alias("said"))


def clock(ms: Column) -> Column:
    """hh:mm:ss of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def time_range(start_ms: Column, end_ms: Column) -> Column:
    """[hh:mm:ss–hh:mm:ss]; null unless 0 <= start <= end."""
    return F.when((start_ms >= 0) & (end_ms >= start_ms), F.concat(F.lit("["), clock(start_ms), F.lit("–"), clock(end_ms), F.lit("]")))


#: How a line may look that is a heading, and how none does (patterns of numbering and of sentences).
HEADING_SIGNS = [r"^#{1,6}\s", r"^\d+(\.\d+)*\.?\s+\S", r"^[IVXLC]+\.\s", r"^[A-Z]\.\s", r"^\(?[a-z0-9]{1,2}\)\s", r"^第[一二三四五六七八九十0-9]+[章节条部篇]", r"^[一二三四五六七八九十]+、", r"^(?i:chapter|section|part|appendix|annex)\b", r"^\*\*.+\*\*$"]
HEADING_AGAINST = [r"[.!?;。！？；]$", r"^[^\p{L}\p{N}]*$", r"^https?://", r"^\|", r"^\d+$", r"\t\S+\t"]


def heading_score(line: Column, limit: int = 60) -> Column:
    """Bits of ``HEADING_SIGNS`` as a number, or -1 where something speaks against a heading."""
    against = F.length(F.trim(line)) > limit
    for p in HEADING_AGAINST:
        against = against | F.trim(line).rlike(p)
    bits = F.lit(0)
    for k, p in enumerate(HEADING_SIGNS):
        bits = bits + F.when(F.trim(line).rlike(p), 1 << k).otherwise(0)
    return F.when(against, -1).otherwise(bits)


def inline_assets(text: Column, assets: Column) -> Column:
    """The text with each asset's body in place of its reference, or at the end where it has none; assets array<struct<ref, body>>, each once."""
    return F.aggregate(F.array_distinct(F.coalesce(assets, F.array().cast("array<struct<ref:string,body:string>>"))), text, lambda t, a: F.when(F.contains(t, a["ref"]), F.replace(t, a["ref"], a["body"])).otherwise(F.concat(t, F.lit("\n"), a["body"])))


def collapse_single_chains(nodes: DataFrame) -> DataFrame:
    """Nodes (node, parent, title) without intermediate nodes whose only child has children itself.

    Such a child is taken up into its parent: titles are joined, its children go one level up. Leaves stay.
    One pass merges every second node of a chain; repeat until the count stays.
    """
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only"))
    inner = kids.select(F.col("parent").alias("node")).distinct()
    # a node with one child which is inner; of neighbours only every second, told by a hash, merges at a time
    merge = kids.where("n = 1").select(F.col("parent").alias("keep"), F.col("only").alias("gone")).join(inner.withColumnRenamed("node", "gone"), "gone", "left_semi")
    blocked = merge.select(F.col("gone").alias("keep"))
    now = merge.join(blocked, "keep", "left_anti")
    titles = nodes.select(F.col("node").alias("gone"), F.col("title").alias("more"))
    named = now.join(titles, "gone")
    out = nodes.join(now.select(F.col("gone").alias("node")), "node", "left_anti").join(named.select(F.col("keep").alias("node"), "more"), "node", "left").withColumn("title", F.concat_ws(" / ", "title", "more")).drop("more")
    moved = now.select(F.col("gone").alias("parent"), F.col("keep").alias("up"))
    return out.join(moved, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"), "title")


def processing_windows(starts: Column, length_ms: int) -> Column:
    """Ascending starts in windows (first_ms, n): one ``length_ms`` or more after its window's first opens the next."""
    kind = "array<struct<first_ms:bigint,n:int>>"

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        opens = (F.size(acc) == 0) | (t - last["first_ms"] >= length_ms)
        fresh = F.concat(acc, F.array(F.struct(t.alias("first_ms"), F.lit(1).alias("n"))))
        return F.when(opens, fresh).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["first_ms"].alias("first_ms"), (last["n"] + 1).alias("n")))))

    return F.aggregate(starts, F.array().cast(kind), step)


#: A line of a list of contents: number, title, leader dots, page.
CONTENTS_LINE = r"^\s*(\d+(?:\.\d+)*)\.?\s+(.*?)\s*\.{3,}\s*(\d+)\s*$"


def contents_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, number, level, title, page) of the lines of lists of contents; level is the depth of the number."""
    part = lambda k: F.regexp_extract("line", CONTENTS_LINE, k)
    return lines.where(F.col("line").rlike(CONTENTS_LINE)).select(key, "line_no", part(1).alias("number"), F.size(F.split(part(1), r"\.")).alias("level"), part(2).alias("title"), part(3).try_cast("int").alias("page"))


def contents_areas(lines: DataFrame, key: str, longest: int = 100) -> DataFrame:
    """(key, area, first_line, last_line, n): runs of contents lines, blank lines between them allowed, at most ``longest`` each."""
    w = Window.partitionBy(key).orderBy("line_no")
    hit = F.col("line").rlike(CONTENTS_LINE)
    kept = lines.where(hit | (F.trim("line") != "")).withColumn("hit", hit)
    runs = kept.withColumn("start", F.when(F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("hit")
    place = runs.withColumn("k", F.floor((F.row_number().over(Window.partitionBy(key, "run").orderBy("line_no")) - 1) / longest))
    return place.groupBy(key, "run", "k").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n")).select(key, F.concat_ws(".", "run", "k").alias("area"), "first_line", "last_line", "n")
