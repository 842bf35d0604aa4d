"""Column expressions for titles, metadata fields, chunk arithmetic and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as Python's str.split() has it; Java's and RE2's ``\s`` are ASCII and differ from each other.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
#: What may not stand beside a whole word; ``\b`` has a different meaning in each version of Java.
WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"
BEFORE_WORD, AFTER_WORD = f"(?<!{WORD})", f"(?!{WORD})"


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Without white space at either end; trim() takes spaces only."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words between white space; no stop words, no stemming."""
    return F.filter(F.split(F.lower(c), WS + "+"), lambda x: x != "")


def normalized_title(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", " "), WS + "+")
    return F.array_join(F.filter(words, lambda x: ~x.isin("", "a", "an", "the")), " ")


def title_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def item_key(path: Column) -> Column:
    return F.upper(F.substring(F.sha2(path, 256), 1, 8))


def citation_key(authors: Column, year: Column) -> Column:
    """Last name of the first author, letters and digits only, and the year; null without both."""
    first = F.get(authors, 0)
    last = F.when(F.contains(first, F.lit(",")), F.split_part(first, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(strip(first), WS + "+"), -1))
    return F.concat(F.regexp_replace(last, r"[^\p{L}\p{N}]", ""), year.cast("string"))


def excerpt(c: Column, n: int = 300) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate(c: Column, n: int) -> Column:
    """At most n characters, cut at the last space if there is one, with an ellipsis."""
    if n <= 0:
        return c
    t = strip(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), " [^ ]*$", ""), F.lit("...")))


def token_count(c: Column) -> Column:
    return F.floor(F.size(tokens(c)) * 1.3).cast("int")


def chunk_estimate(c: Column, size: int = 1024, overlap: int = 100) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), (F.floor(F.length(c) / 4 / (size - overlap)) + 1).cast("int")))


def clean(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, WS + "+", " "), r"[*_`]", ""))


def valid_year(c: Column) -> Column:
    year = c.try_cast("int")
    return F.when(year.between(1950, 2050), year)


def first_year(c: Column) -> Column:
    """The first year from 1950 to 2050 in the first 1000 characters."""
    found = F.transform(F.regexp_extract_all(F.substring(c, 1, 1000), F.lit(BEFORE_WORD + r"((?:19|20)[0-9]{2})" + AFTER_WORD), F.lit(1)), lambda x: x.cast("int"))
    return F.get(F.filter(found, lambda y: y.between(1950, 2050)), 0)


def filename_year(c: Column) -> Column:
    """The first four digits of a path's last part."""
    return valid_year(nonempty(F.regexp_extract(F.substring_index(c, "/", -1), r"([0-9]{4})", 1)))


def pdf_date_year(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("D:")), valid_year(F.substring(c, 3, 4)))


def valid_doi(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)^10\.\d{4,}/.{1,200}$"), c)


def doi(c: Column) -> Column:
    head = F.substring(c, 1, 2000)
    found = [F.regexp_extract(head, p, 1) for p in (rf"(?i)doi:{WS}*(10\.[0-9]{{4,}}/{NOT_WS}+)", rf"(?i)doi\.org/(10\.[0-9]{{4,}}/{NOT_WS}+)", rf"{BEFORE_WORD}(10\.[0-9]{{4,}}/{NOT_WS}+)")]
    return F.coalesce(*(valid_doi(nonempty(F.regexp_replace(x, r"[.,;)\]\n]+$", ""))) for x in found))


def author_list(c: Column) -> Column:
    parts = F.transform(F.split(c, rf"[,;]{WS}*(?:and{WS}+)?"), lambda x: strip(F.replace(x, F.lit(" et al."), F.lit(""))))
    return F.filter(parts, lambda x: x != "")


def pdf_authors(c: Column) -> Column:
    parts = F.when(F.contains(c, F.lit(" and ")), F.split(c, " and ")).when(F.contains(c, F.lit(", ")), F.split(c, ", ")).when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.array(c))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def pdf_title(c: Column) -> Column:
    """The first of ten lines that is 10 to 200 long and all capitals, or longer than 20 with over two capitals."""
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 10), strip)
    capitals = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    good = lambda x: F.length(x).between(10, 200) & (((x == F.upper(x)) & (x != F.lower(x))) | ((F.length(x) > 20) & (capitals(x) > 2)))
    return F.get(F.filter(lines, good), 0)


def markdown_title(c: Column) -> Column:
    return nonempty(F.regexp_extract(c, r"(?m)^#\s+(.+?)(?:\n|$)", 1))


def markdown_abstract(c: Column) -> Column:
    return nonempty(F.substring(strip(F.regexp_extract(c, r"(?is)##\s*Abstract\s*\n\n(.+?)(?=\n##|\z)", 1)), 1, 500))


def tags(c: Column, dictionary: dict[str, list[str]]) -> Column:
    """Sorted tags of which any keyword occurs, whatever its case."""
    low = F.lower(c)
    hits = []
    for tag, words in sorted(dictionary.items()):
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | F.contains(low, F.lit(w.lower()))
        hits.append(F.when(any_of, F.lit(tag)))
    return F.array_compact(F.array(*hits))


def instruments(c: Column, patterns: dict[str, str]) -> Column:
    """Names whose pattern occurs, in the dictionary's order; patterns are case-sensitive, ``\\b`` bounds whole words."""
    bound = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    patterns = {name: p.replace(r"\b", bound) for name, p in patterns.items()}
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items())))


def data_uri(data: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(data))


def uri_bytes(c: Column) -> Column:
    """The bytes of a data URI; null for other strings."""
    return F.when(c.rlike("^data:[^,]*;base64,"), F.unbase64(F.split_part(c, F.lit(","), F.lit(2))))


def paper_of_chunk(c: Column) -> Column:
    """What stands before the last ``_chunk_`` of a chunk's id; the id itself without one."""
    return F.regexp_replace(c, "(?s)_chunk_((?!_chunk_).)*$", "")


def paper_of_part(c: Column) -> Column:
    """What stands before the first hyphen of a chunk's id."""
    return F.substring_index(c, "-", 1)


def three_places(c: Column) -> Column:
    """A score as shown to readers."""
    return F.format_string("%.3f", c)
