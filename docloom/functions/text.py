"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations and what they become, applied in this order, in any case, at the start of a word.
ABBREVIATIONS = (
    (r"no\.[\s\p{Z}]", "Number"),
    (r"fig\.", "Figure"),
    (r"eq\.", "Equation"),
    (r"mr\.", "Mr"),
    (r"mrs\.", "Mrs"),
    (r"dr\.", "Dr"),
    (r"jr\.", "Jr"),
    (r"etc\.", "etc"),
)

#: A dot with what ABBREVIATIONS may find before it: a text without any stays as it is. Dots are looked for first.
ABBREVIATED = r"(?i)(?U)\.(?<=(?:no|fig|eq|mrs?|dr|jr|etc)\.)"

# Patterns that decide what counts as a page number, date, time, e-mail address, phone number and postal
# address. All but the e-mail address ignore case; classes are those of Unicode. PAGE_NUMBER leaves out a boundary that
# what follows it implies, and DATE is put together from its named parts; both match the same texts as the fixed values.
PAGE_NUMBER = r"(?:-|\( ?)?\b(?:page|p\.?(?:[pg]\.?)?)? ?(?:\d+|\b[ivxm]+\b)\.?(?: ?-|\))?\b"
MONTH = r"(?:jan\.?|january|feb\.?|february|mar\.?|march|apr\.?|april|may|jun\.?|june|jul\.?|july|aug\.?|august|sep\.?|september|oct\.?|october|nov\.?|november|dec\.?|december)"
DAY = r"(?<!\:)(?<!\:\d)[0-3]?\d(?:st|nd|rd|th)?"
DATE = rf"(?iU)(?:{DAY}\s+(?:of\s+)?{MONTH}|{MONTH}\s+{DAY})(?:\,)?\s*(?:\d{{4}})?|[0-3]?\d[-\./][0-3]?\d[-\./]\d{{2,4}}"
TIME = r"(?iU)\d{1,2}:\d{2} ?(?:[ap]\.?m\.?)?|\d[ap]\.?m\.?"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?U)(?<![\d-])(?:\+?\d{1,3}[-.\s*]?)?(?:\(?\d{3}\)?[-.\s*]?)?\d{3}[-.\s*]?\d{4}(?![\d-])|(?<![\d-])(?:\(\+?\d{2}\)|\+?\d{2})\s*\d{2}\s*\d{3}\s*\d{4}(?![\d-])"
STREET = r"(?:street|st|avenue|ave|road|rd|highway|hwy|square|sq|trail|trl|drive|dr|court|ct|parkway|pkwy|circle|cir|boulevard|blvd)"
ADDRESS = rf"(?iU)\d{{1,4}}.{{1,10}}[\w\s]{{1,20}}\s+{STREET}\W?(?=\s|$)"


def clean_control_chars(text: Column) -> Column:
    """Without control and surrogate characters, then without the glyph markers ``(cid:N)``. Line breaks go too."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cs}]+", ""), r"\(cid:[0-9]+\)", "")


def clean_lines(text: Column) -> Column:
    """Each line as ``clean_control_chars`` has it; the line breaks stay."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cs}&&[^\n]]+", ""), r"\(cid:[0-9]+\)", "")


def clean_abbreviations(text: Column) -> Column:
    """ABBREVIATIONS spelled out or without their dots; "No." takes the blank after it along."""
    plainer = text
    for found, plain in ABBREVIATIONS:
        plainer = F.regexp_replace(plainer, r"(?i)(?U)\b" + found, plain)
    return F.when(text.rlike(ABBREVIATED), plainer).otherwise(text)


def is_page_number(text: Column) -> Column:
    return text.rlike(r"(?iU)\A(?:" + PAGE_NUMBER + r")\z")


def starts_with_page_number(text: Column) -> Column:
    return text.rlike(r"(?iU)\A(?:" + PAGE_NUMBER + ")")


def without_page_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "(?iU)" + PAGE_NUMBER, "")


def normalised(text: Column) -> Column:
    """Lower case, everything but letters and digits as blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]|_", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def shortened(text: Column, length: int = 100) -> Column:
    """Trimmed; if longer than ``length``, cut there and marked by three dots."""
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) > length, F.concat(F.left(trimmed, F.lit(length)), F.lit("..."))).otherwise(trimmed)


def file_name(directory: Column, name: Column) -> Column:
    """``directory/name`` where both are there, else what there is."""
    return F.nullif(F.concat_ws("/", F.nullif(directory, F.lit("")), F.nullif(name, F.lit(""))), F.lit(""))


def whitespace_before(text: Column, index: Column) -> Column:
    """Position of the last white space strictly before ``index``, else 0; null outside the text."""
    head = F.substring(text, F.lit(1), index)
    at = F.length(F.regexp_extract(head, r"^([\s\S]*)\s\S*$", 1))
    return F.when((index >= 0) & (index < F.length(text)), F.when(head.rlike(r"\s"), at).otherwise(0))


def whitespace_after(text: Column, index: Column) -> Column:
    """Position of the first white space at or after ``index``, else the length; null outside the text."""
    tail = F.substring(text, index + 1, F.length(text))
    run = F.length(F.regexp_extract(tail, r"^(\S*)", 1))
    return F.when((index >= 0) & (index < F.length(text)), index + run)


def pdf_display(content: Column, width: str = "100%", height: str = "500", page: int | None = None) -> Column:
    """An HTML embed of a PDF as a data URI without line breaks; the page fragment is part of the address."""
    fragment = f"#page={page}" if page is not None else ""
    return F.concat(F.lit('<embed src="data:application/pdf;base64,'), F.translate(F.base64(content), "\r\n", ""), F.lit(f'{fragment}" width="{width}" height="{height}" type="application/pdf">'))


def qa_prompt(context: Column, query: Column) -> Column:
    return F.format_string("Use only these passages:\n%s\n\nQuestion: %s\nAnswer:", context, query)


def refine_prompt(existing: Column, context: Column, query: Column) -> Column:
    return F.format_string("Question: %s\nAnswer so far: %s\nMore passages:\n%s\nAnswer, improved where they help:", query, existing, context)


def summary_prompt(context: Column) -> Column:
    return F.format_string("Summarise what follows.\n%s\nSummary:", context)


def oneline_prompt(context: Column) -> Column:
    return F.format_string("Say in one sentence what this is about.\n%s\nSentence:", context)


def table_prompt(table: Column, context: Column) -> Column:
    return F.format_string("Describe the table's content.\n%s\nNearby text:\n%s\nDescription:", table, context)


def image_prompt(context: Column) -> Column:
    return F.format_string("Describe the picture. Text near it:\n%s\nDescription:", context)


def chat_prompt(messages: Column) -> Column:
    """A generic prompt from an array of (role, content)."""
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit("> "), F.coalesce(m["content"], F.lit("")))), "\n"), F.lit("\n<assistant> "))
