"""Text functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A chunk reference as it stands in texts.
CHUNK_REF = r"\[\[?(?:chunk|image|table):[^\]\s]+\]?\]"
SEPARATOR = " / "
SLASH, SLASH_STAND_IN = "/", "∕"


def tokens(text: Column) -> Column:
    """Retrieval tokens, null gives none: chunk references are left out, text is lower-cased and cut into runs of CJK characters and
    runs of other letters and digits. Runs of two characters or more with an ASCII letter, digit or CJK character count;
    of a CJK run each pair of neighbouring characters is a token, as there are no spaces to tell its words.
    """
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), CHUNK_REF, " "))
    runs = F.regexp_extract_all(F.regexp_replace(low, "([一-鿿]+)", " $1 "), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    kept = F.filter(runs, lambda x: (F.length(x) >= 2) & x.rlike(r"[a-z0-9一-鿿]"))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(kept, lambda x: F.when(x.rlike("^[一-鿿]"), pairs(x)).otherwise(F.array(x))))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def unit_count(text: Column) -> Column:
    """Words as a reader counts them: each CJK character, run of Latin letters or run of digits is one."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([一-鿿]|[A-Za-z]+|[0-9]+)"), F.lit(1)))


def preview(text: Column, head: int = 200, tail: int = 50) -> Column:
    """The text, or its first and last words around ' … ' where it is longer than both together."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.size(words)
    return F.when(n <= head + tail, F.array_join(words, " ")).otherwise(F.concat(F.array_join(F.slice(words, 1, head), " "), F.lit(" … "), F.array_join(F.slice(words, -tail, tail), " ")))


def normal_keyword(word: Column) -> Column:
    """Keyword in comparable form, null where it says nothing (one character, or a mere number)."""
    low = F.trim(F.regexp_replace(F.lower(word), r"\s+", " "))
    return F.when((F.length(low) > 1) & ~low.rlike(r"^\d+[.,%]*$"), low)


def normal_path(path: Column) -> Column:
    """Segments trimmed, empty ones dropped, joined with ' / '; nothing left is 'Root'."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.lit("Root")).otherwise(F.array_join(parts, SEPARATOR))


def parent_path(path: Column) -> Column:
    """All but the last segment; null at the top."""
    parts = F.split(path, SEPARATOR)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), SEPARATOR))


def path_prefixes(path: Column) -> Column:
    """The path of each ancestor and of the node itself, from the top."""
    parts = F.split(path, SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), SEPARATOR))


def escape_segment(title: Column) -> Column:
    """A title as a path segment: its slashes as stand-ins, stand-ins of its own doubled."""
    return F.replace(F.replace(title, F.lit(SLASH_STAND_IN), F.lit(SLASH_STAND_IN * 2)), F.lit(SLASH), F.lit(SLASH_STAND_IN))


def unescape_segment(segment: Column) -> Column:
    """The inverse for single stand-ins and pairs: a pair is a stand-in, a single one a slash."""
    hold = "\u0000"
    return F.replace(F.replace(F.replace(segment, F.lit(SLASH_STAND_IN * 2), F.lit(hold)), F.lit(SLASH_STAND_IN), F.lit(SLASH)), F.lit(hold), F.lit(SLASH_STAND_IN))


def snippet(text: Column, term: Column, head: int = 60, around: int = 80, tail: int = 40) -> Column:
    """Head, surroundings of the first match and tail, joined by '...'; texts no longer than all three stay whole."""
    n, at = F.length(text), F.instr(F.lower(text), F.lower(term))
    a, b = F.greatest(at - around, F.lit(1)), F.least(at + F.length(term) + around, n + 1)
    parts = F.concat_ws(
        "...",
        F.substring(text, 1, head),
        F.when((at > 0) & (b > head + 1) & (a < n - tail + 1), F.substring(text, F.greatest(a, F.lit(head + 1)), F.greatest(F.least(b, n - tail + 1) - F.greatest(a, F.lit(head + 1)), F.lit(0)))),
        F.substring(text, n - tail + 1, F.lit(tail)),
    )
    return F.when(n <= head + tail + 2 * around, text).otherwise(parts)


def main_script(text: Column) -> Column:
    """'zh', 'en' or 'other', by which of CJK and Latin letters are more."""
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when((cjk == 0) & (latin == 0), "other").when(cjk >= latin, "zh").otherwise("en")


def scrub_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def mask_key(key: Column) -> Column:
    """First and last four characters of a key; short ones are hidden altogether."""
    return F.when(F.length(key) > 8, F.concat(F.left(key, F.lit(4)), F.lit("..."), F.right(key, F.lit(4)))).otherwise(F.lit("***"))


def chunk_refs(text: Column) -> Column:
    """Chunk references in order, each once, with the places of their first occurrence: array<struct<ref, start, end>>, end exclusive, from 0."""
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CHUNK_REF})"), F.lit(1)))
    return F.transform(refs, lambda r: F.struct(r.alias("ref"), (F.instr(text, r) - 1).alias("start"), (F.instr(text, r) - 1 + F.length(r)).alias("end")))


def without_refs(text: Column) -> Column:
    return F.regexp_replace(text, CHUNK_REF, "")


SAME_AS = r"\[SAME-AS [^\]]*\]"


def content_search_text(content: Column, summary: Column, entities: Column, section_summary: Column) -> Column:
    """Tokens of what is searched as content, joined by blanks; null where there is nothing. SAME-AS marks don't count; ``entities`` is an array."""
    raw = F.concat_ws(" ", F.regexp_replace(content, SAME_AS, ""), summary, F.array_join(entities, " "), section_summary)
    return F.nullif(F.array_join(tokens(raw), " "), F.lit(""))


def path_search_text(*parts: Column) -> Column:
    """Tokens of file name, path, title and summary, joined by blanks."""
    return F.array_join(tokens(F.concat_ws(" ", *parts)), " ")


def term_search_text(content: Column, path: Column) -> Column:
    """What literal searches look through: the text as it stands, and the path below it."""
    return F.concat_ws("\n", content, path)


def lexical_text(text: Column) -> Column:
    """A text and, in a line below, its tokens, each once."""
    return F.concat_ws("\n", text, F.array_join(distinct_tokens(text), " "))


def row_text(kind: Column, title: Column, document: Column, path: Column, score: Column, depth: Column, hit: Column) -> Column:
    """A result row as one line: kind, title, document, section, score, and a mark if it is a hit; two blanks of indent a level."""
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- ["), kind, F.lit("]"), F.coalesce(F.concat(F.lit(" "), F.nullif(title, F.lit(""))), F.lit("")), F.lit(" | document_id="), document, F.lit(" section_path="), path, F.coalesce(F.concat(F.lit(" score="), score.cast("string")), F.lit("")), F.when(hit, " [Hit]").otherwise(""))


_BOLD = r"^(\*{2,3}|_{2,3})(\S(?:.*\S)?)\1$"


def plain_line(line: Column) -> tuple[Column, Column]:
    """(line without the bold marks around all of it, whether it had them)."""
    bold = line.rlike(_BOLD) & ~F.regexp_extract(line, _BOLD, 2).rlike(r"\*\*|__")
    return F.when(bold, F.trim(F.regexp_extract(line, _BOLD, 2))).otherwise(line), bold


def match_text(text: Column) -> Column:
    """Text as literal matches compare it: lower case, blanks in a row as one, none beside a CJK character; full-width forms as plain ones."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = F.translate(F.lower(F.translate(F.coalesce(text, F.lit("")), wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))), "　", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"(?<=[一-鿿]) | (?=[一-鿿])", ""))


def speaker_line(speaker: Column, said: Column) -> Column:
    """S{n+1} for a speaker's number n, and what was said."""
    return F.concat(F.lit("S"), (speaker + 1).cast("string"), F.lit(": "), said)


def token_estimate(text: Column) -> Column:
    """Tokens a model may take a text for: CJK characters by 1.5, ASCII words by 4 and other characters by 3, but at least length by 2.5; 0 for no text, else 1 at least."""
    n = F.length(text)
    zh, ascii_ = F.length(F.regexp_replace(text, r"[^一-鿿]", "")), F.length(F.regexp_replace(text, r"[^A-Za-z0-9_]", ""))
    mixed = zh / 1.5 + ascii_ / 4.0 + F.greatest(n - zh - ascii_, F.lit(0)) / 3.0
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.greatest(mixed, n / 2.5)).cast("int")))
