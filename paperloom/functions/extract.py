"""Metadata from documents' texts as column expressions: authors, journal, year, abstract, keywords, and their merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WS, WS, author_list, clean, doi, filename_year, first_year, markdown_abstract, markdown_title, nonempty, pdf_authors, pdf_title, strip, valid_year

# The line formats that metadata is read from, for markdown files and for page text.
MD_AUTHORS = rf"(?i)(?:\*\*Authors?:\*\*{WS}*|Authors?:{WS}*)(.+?)(?:\n|\*\*|$)"
MD_JOURNAL = rf"(?i)(?:\*\*Journal:\*\*{WS}*|Journal:{WS}*|Published in:?{WS}*)(.+?)(?:\n|\*\*|$)"
MD_DOI = rf"(?i)(?:\*\*DOI:\*\*{WS}*|DOI:{WS}*)(https?://doi\.org/[\p{{L}}\p{{N}}_./()-]+)"
MD_YEAR = r"(?i)(?:Publication Date|Published|Year).*?([0-9]{4})"
PAGE_AUTHORS = (rf"(?im)Authors?:{WS}*(.+?)(?:\n|$)", rf"(?im)By{WS}+(.+?)(?:\n|$)")
PAGE_TWO_AUTHORS = rf"(?im)^([A-Z][a-z]+ [A-Z][a-z]+){WS}+and{WS}+([A-Z][a-z]+ [A-Z][a-z]+)"
PAGE_JOURNALS = (rf"(?im)Journal:{WS}*(.+?)(?:\n|,)", rf"(?im)Published in{WS}+(.+?)(?:\n|,)", rf"(?im)(?:^|\n)(.+?){WS}+\(Journal\)")
PAGE_ABSTRACTS = (
    rf"(?is)(?:^|\n){WS}*Abstract(?::|{WS})*\n(.+?)(?:\n{WS}*(?:Introduction|Keywords|1\.|References|\z))",
    rf"(?is)(?:^|\n)Summary(?::|{WS})*\n(.+?)(?:\n{WS}*(?:Introduction|Keywords|1\.|\z))",
)
PAGE_KEYWORDS = rf"(?is)(?:Keywords|Key{WS}*words|Key{WS}*terms)(?::|{WS})*(.+?)(?:\n{WS}*(?:Introduction|1\.|\z))"
SEPARATORS = (";", ",", "·", "•")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group holds, without white space at its ends; null where that is nothing."""
    return nonempty(strip(F.regexp_extract(c, pattern, group)))


def _parts(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def markdown_authors(c: Column) -> Column:
    return author_list(found(c, MD_AUTHORS))


def markdown_journal(c: Column) -> Column:
    return found(c, MD_JOURNAL)


def markdown_doi(c: Column) -> Column:
    return found(c, MD_DOI)


def markdown_year(c: Column, path: Column) -> Column:
    """The first four digits after a date's label on its line, else those of the file's name."""
    return F.coalesce(valid_year(found(c, MD_YEAR)), filename_year(path))


def page_authors(c: Column) -> Column:
    """From the first 1000 characters: a labelled line, a by-line, or a line that begins with two names; else empty."""
    head = F.substring(c, 1, 1000)
    two = F.array(found(head, PAGE_TWO_AUTHORS, 1), found(head, PAGE_TWO_AUTHORS, 2))
    lines = [F.when(found(head, p).isNotNull(), pdf_authors(found(head, p))) for p in PAGE_AUTHORS]
    return F.coalesce(*lines, F.when(two[0].isNotNull(), two), F.array().cast("array<string>"))


def page_journal(c: Column) -> Column:
    """A journal's name of 11 to 199 characters from the first 1000."""
    names = [found(F.substring(c, 1, 1000), p) for p in PAGE_JOURNALS]
    return F.coalesce(*(F.when(F.length(n).between(11, 199), n) for n in names))


def page_abstract(c: Column) -> Column:
    """The section below an abstract's or a summary's heading in the first 3000 characters, on one line.

    Over 1000 characters it ends at the last space before, with an ellipsis; 50 and fewer are none.
    """
    head = F.substring(c, 1, 3000)
    for_one = []
    for p in PAGE_ABSTRACTS:
        line = F.regexp_replace(found(head, p), WS + "+", " ")
        cut = F.when(F.length(line) > 1000, F.concat(F.regexp_replace(F.substring(line, 1, 1000), " [^ ]*$", ""), F.lit("..."))).otherwise(line)
        for_one.append(F.when(F.length(cut) > 50, cut))
    return F.coalesce(*for_one)


def page_keywords(c: Column, most: int = 10) -> Column:
    """Up to ten keywords of the section in the first 3000 characters, by the first separator in it, else words over two letters."""
    line = F.regexp_replace(found(F.substring(c, 1, 3000), PAGE_KEYWORDS), WS + "+", " ")
    split = F.filter(F.split(line, " "), lambda x: F.length(x) > 2)
    for s in reversed(SEPARATORS):
        split = F.when(F.contains(line, F.lit(s)), _parts(line, s)).otherwise(split)
    return F.coalesce(F.slice(split, 1, most), F.array().cast("array<string>"))


def native_keywords(c: Column) -> Column:
    return F.coalesce(_parts(c, "[;,]"), F.array().cast("array<string>"))


def markdown_fields(text: Column, path: Column) -> dict[str, Column]:
    """A markdown file's fields by name; the title falls back to the file's name, the year to its digits."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return {
        "title": F.coalesce(clean(markdown_title(text)), name), "authors": markdown_authors(text), "year": markdown_year(text, path), "publication": markdown_journal(text),
        "doi": markdown_doi(text), "abstract": markdown_abstract(text), "keywords": F.array().cast("array<string>"),
    }


def page_fields(text: Column, path: Column, native: dict[str, Column] | None = None) -> dict[str, Column]:
    """A page file's fields by name: its own metadata first, then the text, then the file's name."""
    native = native or {}
    own = lambda k: [nonempty(strip(native[k]))] if k in native else []
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    authors, keywords = page_authors(text), page_keywords(text)
    if "author" in native:
        authors = F.coalesce(F.when(native["author"].rlike(NOT_WS), pdf_authors(native["author"])), authors)
    if "keywords" in native:
        keywords = F.when(native["keywords"].rlike(NOT_WS), native_keywords(native["keywords"])).otherwise(keywords)
    return {
        "title": F.coalesce(*own("title"), pdf_title(text), name), "authors": authors, "year": F.coalesce(first_year(text), filename_year(path)), "publication": page_journal(text),
        "doi": doi(text), "abstract": F.coalesce(*own("subject"), page_abstract(text)), "keywords": keywords,
    }


def embedding_text(f: dict[str, Column], content: Column | None = None) -> Column:
    """A document's fields as one text, the most telling first; parts without a value are left out."""
    labelled = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    keywords = F.array_join(F.sort_array(F.array_distinct(F.concat(f["keywords"], f["tags"]) if "tags" in f else f["keywords"])), ", ")
    venue = F.concat(f["publication"], F.coalesce(F.concat(F.lit(" ("), f["year"].cast("string"), F.lit(")")), F.lit("")))
    parts = [labelled("Title: ", f["title"]), labelled("Authors: ", F.array_join(f["authors"], "; ")), labelled("Abstract: ", f["abstract"]), labelled("Published in: ", F.when(f["publication"] != "", venue)), labelled("Keywords: ", keywords)]
    return F.concat_ws("\n\n", *parts, *([labelled("Content: ", content)] if content is not None else []))


#: Fields of stored metadata and what stands for a missing one.
UNKNOWN = {"title": "Unknown", "authors": "Unknown", "year": "Unknown"}
FIELDS = ("item_key", "filename", "file_type", "title", "authors", "year", "doi", "citation_key", "publication", "abstract", "keywords", "tags", "collections", "has_fulltext", "fulltext_source", "is_scanned", "page_count", "date_added", "date_modified")


def metadata_strings(columns: dict[str, str], given: dict[str, Column]) -> list[Column]:
    """All stored fields as strings: lists joined, booleans as True and False, times as ISO dates, missing ones replaced.

    columns: the types of the given columns by name.
    """
    out = []
    for name in FIELDS:
        kind = columns.get(name)
        if kind is None:
            c = F.lit(None).cast("string")
        elif kind.startswith("array"):
            c = F.array_join(given[name], ", ")
        elif kind == "boolean":
            c = F.when(given[name], "True").otherwise("False")
        elif kind.startswith("timestamp"):
            c = F.date_format(given[name], "yyyy-MM-dd'T'HH:mm:ss")
        else:
            c = given[name].cast("string")
        missing = "False" if name in ("has_fulltext", "is_scanned") else UNKNOWN.get(name, "")
        out.append(F.coalesce(nonempty(c), F.lit(missing)).alias(name))
    return out
