"""Text as Columns: cleaning, tokens, visible text of HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "nothing" (fixed values).
NULL_WORDS = ("", "n/a", "na", "none", "null", "nil", "-", "--", "–", "—", "tbd", "tba", "unknown", "unspecified")
#: Headings after which an article has ended (fixed values).
END_HEADINGS = ("references", "external links", "further reading", "see also", "notes", "bibliography", "citations", "footnotes", "sources", "works cited")
#: What looks like somebody's key at the start of a value (fixed pattern).
CREDENTIAL = r"^\s*(sk_live_|sk_static_|sk-[A-Za-z0-9]{16,}|pk_live_|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-)"
#: Suffixes that a stem loses, the first that fits (fixed values).
SUFFIXES = ("ations", "ation", "ingly", "edly", "ing", "ies", "ied", "es", "ed", "ly", "s")
#: Footnote marks, and pronunciations in parentheses (fixed patterns).
CITATION = r"(?i)\[\s*(?:\d{1,3}|[a-z]{1,4})\s*\]"
PHONETIC = "\\s*\\([^()]{0,400}[ɐ-˿][^()]{0,400}\\)"
LIST_ROW = r"^[A-Z][\w./-]{2,40}( - | – |: ).{20,80}$"
TAG = r"<[^>]{0,200}>"
HIDDEN = r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>"
COMMENT = r"(?s)<!--.*?-->"


def is_null_word(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*NULL_WORDS)


def squeeze(c: Column) -> Column:
    """One blank between words, none around them."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_string(c: Column) -> Column:
    """Without tags, white space made single; blank becomes null."""
    s = squeeze(F.regexp_replace(c, TAG, " "))
    return F.when(s != "", s)


def hide_credential(c: Column) -> Column:
    return F.when(~c.rlike(CREDENTIAL), c)


def visible_text(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments."""
    plain = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), COMMENT, " ")
    return squeeze(F.regexp_replace(plain, r"<[^>]+>", " "))


def digit_share(html: Column) -> Column:
    text = visible_text(html)
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.length(text)).otherwise(F.lit(0.0))


def strip_citations(c: Column) -> Column:
    """Without footnote marks and pronunciations in parentheses; runs of blanks made single."""
    s = F.regexp_replace(F.regexp_replace(c, CITATION, ""), PHONETIC, "")
    return F.trim(F.regexp_replace(s, r"  +", " "))


def cut_at_end_heading(c: Column) -> Column:
    """The lines before the first that is an end heading."""
    lines = F.split(c, "\n")
    is_end = F.transform(lines, lambda x: F.lower(F.regexp_replace(F.trim(x), ":+$", "")).isin(*END_HEADINGS))
    at = F.array_position(is_end, True)
    return F.when(at > 0, F.rtrim(F.array_join(F.slice(lines, 1, (at - 1).cast("int")), "\n"))).otherwise(c)


def truncate(c: Column, n: int = 400) -> Column:
    s = F.trim(c)
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n)), F.lit("…"))).otherwise(s)


def stem(word: Column) -> Column:
    """A word of over three letters without the first suffix in SUFFIXES that leaves three letters or more."""
    out = F.when(F.length(word) <= 3, word)
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def tokens(c: Column) -> Column:
    """Stems of the words, with camelCase and snake_case taken apart."""
    # the whole text at a time, words between blanks: a call for each word costs some times as much
    words = F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")))
    # stem() of each: suffixes are in order of length, so the first that fits is the one that leaves least
    stems = F.regexp_replace(words, rf"(^| )([^ ]{{3,}}?)(?:{'|'.join(SUFFIXES)})(?= |$)", "$1$2")
    return F.array_remove(F.split(stems, " "), "")


def letter_tokens(c: Column) -> Column:
    """Distinct runs of two letters a-z or more, in order of first place."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{2,})"), F.lit(1)))


def is_link_list(chunk: Column) -> Column:
    """Four lines or more, over two fifths of which are rows of a list of links."""
    lines = F.filter(F.transform(F.split(chunk, "\n"), lambda y: F.trim(y)), lambda x: x != "")
    return (F.size(lines) >= 4) & (F.size(F.filter(lines, lambda x: x.rlike(LIST_ROW))) > 0.4 * F.size(lines))


def first_group(html: Column, pattern: str) -> Column:
    got = F.regexp_extract(html, pattern, 1)
    return F.when(got != "", got)


def title(html: Column) -> Column:
    return first_group(html, r"(?is)<title[^>]*>(.*?)</title>")


def heading(html: Column) -> Column:
    return first_group(html, r"(?is)<h1[^>]*>(.*?)</h1>")


def lang(html: Column) -> Column:
    return first_group(html, r"(?is)<html[^>]*\blang=\"([^\"]*)\"")
