"""Input formats: dispatch by name, text lines, Markdown, HTML, delimited text, parser rows."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of each input format (fixed values).
EXTENSIONS = {
    "TEXT": ["txt", "json", "log"], "IMAGE": ["png", "jpg", "jpeg", "gif", "webp", "bmp"], "DOC": ["doc"], "DOCX": ["docx"], "SPREADSHEET": ["xlsx", "xls", "csv", "tsv"],
    "MARKDOWN": ["md", "markdown"], "HTML": ["html", "htm"], "MEDIA": ["mp3", "wav", "m4a", "mp4", "mov", "webm"], "PAGES": ["pdf", "pptx"],
}
#: Line ends of text files.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def format_of(name: Column) -> Column:
    """The format a file name's extension stands for, null for unknown ones."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for fmt, exts in EXTENSIONS.items() for e in exts for x in (e, fmt)]
    return F.create_map(*pairs)[ext]


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every text: lines from 0, white space kept, no empty line after a last line end."""
    parts = F.split(F.col(text), LINE_END)
    whole = F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 0), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(whole).alias("line_no", "line"))


def heading(line: Column) -> tuple[Column, Column]:
    """(level, title) of a Markdown heading line, null for other lines."""
    is_heading = line.rlike(r"^\s*#{1,6}\s+\S")
    return F.when(is_heading, F.length(F.regexp_extract(line, r"^\s*(#+)", 1))), F.when(is_heading, F.trim(F.regexp_extract(line, r"^\s*#+\s+(.*)$", 1)))


def markdown_lines(df: DataFrame, key: str, text: str, levels: int = 6) -> DataFrame:
    """(key, line_no, line, level, path) of every line: path is the headings it stands under, joined with ' / '.

    A running last heading per level; it holds unless a heading of a smaller
    level came after it. Windows are per text.
    """
    lines = text_lines(df, key, text)
    level, title = heading(F.col("line"))
    lines = lines.withColumn("level", level).withColumn("title", title)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, levels + 1):
        lines = lines.withColumn(f"_h{k}", F.max(F.when(F.col("level") == k, F.struct("line_no", "title"))).over(w))
    held, above = [], F.lit(-1)
    for k in range(1, levels + 1):
        at = F.coalesce(F.col(f"_h{k}.line_no"), F.lit(-1))
        held.append(F.when(at > above, F.col(f"_h{k}.title")))
        above = F.greatest(above, at)
    return lines.withColumn("path", F.concat_ws(" / ", *held)).drop("title", *[f"_h{k}" for k in range(1, levels + 1)])


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, path, n_lines, body): one row per heading, with the lines up to the next one; 0 is what stands before the first."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = markdown_lines(df, key, text).withColumn("section_no", F.count("level").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, "section_no").agg(F.max("path").alias("path"), F.count(F.lit(1)).alias("n_lines"), body.alias("body"))


class _Markdown(HTMLParser):
    """HTML to Markdown lines; what users don't read is dropped."""

    HIDDEN = {"script", "style", "iframe", "object", "embed", "form", "nav", "noscript"}
    BLOCKS = {"p", "div", "section", "article", "ul", "ol", "li", "tr", "blockquote", "pre", "br", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "main"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.hidden, self.table, self.prefix = [], [], [], 0, ""

    def _flush(self):
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(self.prefix + line)
            self.prefix = ""
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            if tag != "embed":
                self.hidden.append(tag)
        elif self.hidden:
            return
        elif tag == "table" or self.table:
            if not self.table:
                self._flush()
            self.table += tag == "table"
            self.now.append(self.get_starttag_text())
        elif tag == "img":
            self.now.append(f"[Image: {dict(attrs).get('alt') or ''}]")
        elif tag in self.BLOCKS:
            self._flush()
            self.prefix = "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else self.prefix

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif self.table:
            self.now.append(f"</{tag}>")
            self.table -= tag == "table"
            if not self.table:
                self._flush()
        elif tag in self.BLOCKS:
            self._flush()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def html_to_markdown(html: str | None) -> str | None:
    """ATX Markdown of a page: headings, list items, images as ``[Image: alt]``, each table on one line."""
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser._flush()
    return "\n".join(parser.lines)


def html_markdown(html: Column) -> Column:
    """``html_to_markdown`` over a column, in Arrow batches; null gives null."""

    def lines(s: pd.Series) -> pd.Series:
        return s.map(html_to_markdown, na_action="ignore")

    return F.pandas_udf(lines, "string", F.PandasUDFType.SCALAR)(html)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all columns text; quoted line ends are kept, empty fields are null."""
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"', inferSchema=False, emptyValue=None)


def coerced(c: Column) -> Column:
    """A field as the kind of value it looks like: whole number, number, or text (formulas stay text)."""
    t = F.trim(c)
    return F.struct(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")).alias("whole"), F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")).alias("number"), F.when(c != "", c).alias("text"))


METADATA = "struct<keywords:array<string>,summary:string,length:int,page_nums:array<string>,file_path:string,asset_title:string>"


def chunk_records(rows: DataFrame) -> DataFrame:
    """Parser rows (content, path, type, keywords, summary, page_nums, extra) as canonical chunk records.

    Keywords split at ; else at , and keep words of two characters or more;
    unreadable JSON in ``extra`` is null; pages that are no numbers are dropped;
    unknown types are text.
    """
    words = F.transform(F.split(F.col("keywords"), F.when(F.col("keywords").contains(";"), F.lit(";")).otherwise(F.lit(","))), lambda x: F.trim(x))
    pages = F.filter(F.transform(F.split(F.regexp_replace(F.col("page_nums"), r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    kind = F.when(F.col("type").isin("text", "image", "table", "page", "video", "audio"), F.col("type")).otherwise("text")
    return rows.select(
        F.coalesce("content", F.lit("")).alias("content"), "path", kind.alias("chunk_type"), F.filter(words, lambda x: F.length(x) > 1).alias("keywords"), "summary",
        pages.alias("page_nums"), F.from_json("extra", METADATA, {"mode": "PERMISSIVE"}).alias("metadata"), F.length(F.coalesce("content", F.lit(""))).alias("length"),
    )
