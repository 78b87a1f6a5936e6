"""Text expressions: titles, numbers, captions, keys, sentences, definition cues.

All are Column expressions evaluated in the JVM; offsets are 0-based code points. `(?U)` makes Java's character classes
Unicode-aware.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Patterns and limits that decide results.
WS = r"(?U)[\s\x1c-\x1f]"
# Every character the pattern above matches, for tests on single characters.
WS_CHARS = tuple("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
NUMBER = r"(?U)^\s*(\d+(?:\.\d+)*[.)]?|[A-Z][.)])\s+\S"
CAPTION = r"(?Ui)^\s*(Figure|Fig\.?|Table)\s*(\d+)\s*[.:]"
ARXIV = r"(?i)arXiv:\s*(\d{4}\.\d{4,5})"
LINE_HYPHEN = r"(?U)-\s*\n\s*"
SENTENCE_END = r"[.!?][\"”’)]?\s+(?=[A-Z\"“‘(\[])"
SENTENCE_WINDOW = 300
BARE_NUMBER = r"^\d+(\.\d+)*[.)]?$"
HEADING_LABELS = ("section-header", "title")
FURNITURE = ("page-header", "page-footer", "footnote", "caption")
TITLE_CHARS = 80
FIRST_LINE_CHARS = 60
PREVIEW_CHARS = 90
CHIP_WORDS = 3


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def single_spaced(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), WS + "+", " ")


def flat(text: str | Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(single_spaced(text))


def strip_ws(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), WS + "+", "")


def squeeze(text: str | Column) -> Column:
    """Case-folded whitespace-free form used by find."""
    return F.lower(strip_ws(text))


def kept_offsets(text: str | Column) -> Column:
    """For every non-whitespace character its offset in the text. One pass over the characters, which an empty pattern cuts without a match
    for each; of an empty text it leaves one that is none."""
    marked = F.transform(F.split(_c(text), ""), lambda ch, i: F.when(~ch.isin("", *WS_CHARS), i))
    return F.filter(marked, lambda i: i.isNotNull())


def ends_trimmed(text: str | Column) -> Column:
    """Both ends without any whitespace, line breaks included."""
    return F.regexp_replace(_c(text), rf"^{WS}+|{WS}+$", "")


def clean_title(text: str | Column) -> Column:
    return F.regexp_replace(flat(text), r"(?U)^[^\w(\[]+", "")


def section_number(title: str | Column) -> Column:
    """"3.1" from "3.1 Method", "A" from "A. Proofs"; null when the title has none."""
    found = F.regexp_extract(_c(title), NUMBER, 1)
    return F.nullif(F.regexp_replace(found, r"[.)]+$", ""), F.lit(""))


def section_depth(title: str | Column) -> Column:
    return F.coalesce(F.size(F.split(section_number(title), r"\.")), F.lit(1))


def is_heading(label: Column, page: Column, text: str | Column) -> Column:
    title = clean_title(text)
    words = F.split(title, " ")
    short_numbered = (section_number(title).isNotNull() & (F.length(title) <= 80) & (F.size(words) > 1)
                      & F.element_at(words, -1).rlike(r"^\p{Lu}"))
    return (label.isin(*HEADING_LABELS) & ~((label == "title") & (page > 0))
            & F.length(title).between(2, 120) & ~title.rlike(r"(?U)^\d+$") & ~title.rlike(r"^\p{Ll}")
            & (~title.endswith(".") | short_numbered))


def caption_kind(text: str | Column) -> Column:
    word = F.lower(F.regexp_extract(_c(text), CAPTION, 1))
    return F.when(word.startswith("table"), "table").when(word != "", "figure")


def caption_number(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(text), CAPTION, 2), F.lit(""))


def paper_slug(title: Column, first_page: Column, content: Column) -> Column:
    """Slug of at most 60 characters, then the arXiv id printed on page 1, else 10 hex digits of the content's hash."""
    words = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(words, 1, 60), "^-+|-+$", "")
    arxiv = F.nullif(F.regexp_extract(first_page, ARXIV, 1), F.lit(""))
    suffix = F.coalesce(arxiv, F.substring(F.sha2(content.cast("binary"), 256), 1, 10))
    return F.when(slug == "", suffix).otherwise(F.concat_ws("-", slug, suffix))


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def grounding_form(text: str | Column) -> Column:
    """NFKC, line-end hyphens joined, single-spaced. Plain ASCII skips the Python round trip's effect but not its call,
    so callers normalise once per row and reuse the column."""
    return flat(F.regexp_replace(nfkc(_c(text)), LINE_HYPHEN, ""))


def word_key(text: str | Column) -> Column:
    return F.lower(flat(text))


def bare_word(text: str | Column) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"(?U)^\W+|\W+$", ""))


def kept_lines(text: str | Column) -> Column:
    """Lines trimmed, empty ones out."""
    lines = F.transform(F.split(_c(text), r"\r\n|\r|\n"), ends_trimmed)
    return F.filter(lines, lambda ln: ln != "")


def quote_title(text: str | Column) -> Column:
    """First line; a line that is only a heading number takes the next one along."""
    lines = kept_lines(text)
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    return F.when((F.size(lines) > 1) & first.rlike(BARE_NUMBER), F.concat_ws(" ", first, second)).otherwise(first)


def piece_title(kind: Column, node_id: Column, caption: Column, start_exact: Column, blocks_text: Column) -> Column:
    head = ends_trimmed(F.element_at(F.split(F.element_at(F.split(F.coalesce(caption, F.lit("")), ":"), 1), r"\."), 1))
    figure = F.when(head == "", node_id).otherwise(head)
    quoted = F.substring(quote_title(start_exact), 1, TITLE_CHARS)
    plain = F.substring(ends_trimmed(F.coalesce(blocks_text, F.lit(""))), 1, TITLE_CHARS)
    chunk = F.when(strip_ws(F.coalesce(start_exact, F.lit(""))) != "", quoted).otherwise(plain)
    return F.when(kind == "figure", figure).otherwise(chunk)


def first_line(markdown: str | Column, limit: int = FIRST_LINE_CHARS) -> Column:
    lines = F.transform(F.split(_c(markdown), "\n"), lambda ln: ends_trimmed(F.regexp_replace(ln, r"(?U)^\s*#+\s*", "")))
    line = F.coalesce(F.get(F.filter(lines, lambda ln: ln != ""), F.lit(0)), F.lit(""))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def preview(text: str | Column, limit: int = PREVIEW_CHARS) -> Column:
    """One line cut at a word boundary when that keeps more than half."""
    line = flat(text)
    cut = F.substring(line, 1, limit)
    at = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based last space when there is one
    short = F.when((F.locate(" ", F.reverse(cut)) > 0) & (at > limit / 2), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def first_words(text: str | Column, count: int = CHIP_WORDS) -> Column:
    return F.array_join(F.slice(F.split(flat(text), " "), 1, count), " ")


def section_ref(number: Column, title: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(number, F.lit("")), r"\.$", "")
    return F.when(bare != "", F.concat(F.lit("§"), bare)).otherwise(title)


def section_label(number: Column, title: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(number, F.lit("")), r"\.$", "")
    return F.when(bare != "", F.concat(F.lit("§"), bare, F.lit(" "), title)).otherwise(title)


def page_range(first_page: Column, last_page: Column) -> Column:
    """Pages are stored from 0 and printed from 1."""
    a, b = (first_page + 1).cast("string"), (last_page + 1).cast("string")
    return F.when(first_page == last_page, F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("–"), b))


def context_before(text: Column, start: Column, chars: int) -> Column:
    return F.substring(text, F.greatest(start - chars, F.lit(0)) + 1, F.least(start, F.lit(chars)))


def sentence_before(text: Column, start: Column) -> Column:
    head = context_before(text, start, SENTENCE_WINDOW)
    return F.regexp_replace(head, "(?s)^.*" + SENTENCE_END, "")


def sentence_after(text: Column, end: Column) -> Column:
    tail = F.substring(text, end + 1, F.lit(SENTENCE_WINDOW))
    cut = F.regexp_extract(tail, r"(?s)^(.*?[.!?][\"”’)]?)\s+(?=[A-Z\"“‘(\[])", 1)
    return F.when(cut != "", cut).otherwise(tail)


def sentence_around(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The words of the sentence before and after [start, end), single-spaced."""
    return single_spaced(sentence_before(text, start)), single_spaced(sentence_after(text, end))


def sentence_holding(page_text: Column, quote: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    """Flattened variant: the occurrence chosen by the quote's own context, ends at ". ", "? " or "! "."""
    flat_page, needle = single_spaced(page_text), flat(quote)
    before = single_spaced(F.coalesce(prefix if prefix is not None else F.lit(""), F.lit("")))
    after = single_spaced(F.coalesce(suffix if suffix is not None else F.lit(""), F.lit("")))

    def at(head: Column, tail: Column) -> Column:
        found = F.position(F.concat(head, needle, tail), flat_page)
        return F.when((F.concat(head, tail) != "") & (found > 0), found + F.length(head))

    plain = F.position(needle, flat_page)
    where = F.coalesce(at(before, after), at(before, F.lit("")), at(F.lit(""), after), F.when(plain > 0, plain))
    head = F.substring(flat_page, F.lit(1), where - 1)
    start = F.regexp_replace(head, r"(?s)^.*[.?!] ", "")
    rest = F.substring(flat_page, where + F.length(needle), F.length(flat_page))
    stop = F.regexp_extract(rest, r"(?s)^(.*?[.!?])(?=\s|$)", 1)
    tail = F.when(stop != "", stop).otherwise(rest)
    return F.when((needle == "") | where.isNull(), needle).otherwise(F.trim(F.concat(start, needle, tail)))


# The named cues of a definition, their weights and tests on (before, after).
_QUOTE_END = r"[\"“‘']?\s*$"
DEFINITION_CUES: list[tuple[str, int, str | None, str | None, str]] = [
    # name, weight, pattern on the words before, pattern on the words after, how the two combine
    ("we define", 2, r"(?i)\bwe\s+define\b", None, "any"),
    ("defined as", 2, None, r"(?i)^\W*(is|are)\s+defined\s+(as|by|to\s+be)\b", "any"),
    ("denoted by", 2, r"(?i)\bdenoted?\s+(by|as)" + _QUOTE_END, r"(?i)^\W*(is|are)?\s*denoted\s+(by|as)\b", "any"),
    ("let … be", 2, r"(?i)\blet\b[^.]*$", r"(?i)^\W*be\b", "all"),
    ("we call", 2, r"(?i)\bwe\s+call\b", None, "any"),
    ("called", 2, r"(?i)\b(called|termed|known\s+as)" + _QUOTE_END,
     r"(?i)^[\"”’']?\s*,\s*(?:(?:also|sometimes|often|commonly)\s+)?(?:called|termed|known\s+as)\b", "any"),
    ("refer to … as", 2, r"(?i)\brefer(red)?\s+to\b.*\bas" + _QUOTE_END, None, "any"),
    ("abbreviation follows", 2, None, r"^\s*\(\s*[A-Z][A-Za-z0-9-]{0,11}\s*\)", "any"),
    ("the abbreviation itself", 2, r"\(\s*$", r"^\s*\)", "all"),
]
LIKELY_SCORE = 2


def definition_rules(before: Column, after: Column, first: Column) -> Column:
    """Names of the cues a hit meets, in rule order."""
    names = [F.when(first, "first occurrence")]
    for name, _weight, pre, post, how in DEFINITION_CUES:
        tests = [c.rlike(p) for c, p in ((before, pre), (after, post)) if p]
        test = tests[0] if len(tests) == 1 else (tests[0] & tests[1] if how == "all" else tests[0] | tests[1])
        names.append(F.when(test, name))
    names.append(F.when(after.rlike(r"^[\"”’']?\s*:") & after.rlike("[a-z]"), "colon follows"))
    names.append(F.when(F.concat_ws(" ", before, after).rlike(r"(?i)\bi\.\s?e\.|\bthat is,"), "i.e."))
    return F.array_compact(F.array(*names))


def definition_score(rules: Column) -> Column:
    """Two points a cue, one for the two weak ones."""
    weak = F.size(F.filter(rules, lambda r: r.isin("first occurrence", "i.e.")))
    return 2 * F.size(rules) - weak


# Fixed value: every in-text pointer as one alternation; kinds start differently, so scanning it once already gives the
# earliest, longest, non-overlapping pointers.
REFERENCE = (r"\b(?:Figure|Fig\.)\s*\d+\b|\bTable\s*\d+\b|\bEqn?\.\s*\(\s*\d+\s*\)|\bEquation\s*(?:\(\s*\d+\s*\)|\d+\b)"
             r"|\b(?:Section|Sec\.)\s*\d+(?:\.\d+)*|§\s*\d+(?:\.\d+)*|\[\s*\d+(?:\s*,\s*\d+)*\s*\]")


def match_spans(text: Column, pattern: str | Column) -> Column:
    """Non-overlapping matches as an array of (start, end, text): gaps and matches are measured alternately. The text is matched once, and
    once more where there is a match."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, p: Column) -> Column:
        s = acc["pos"] + p["gap"]
        e = s + F.length(p["hit"])
        return F.struct(e.alias("pos"), F.array_append(acc["out"], F.struct(
            s.alias("start"), e.alias("end"), p["hit"].alias("text"))).alias("out"))

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pat, -1), F.length)
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)

    return F.get(F.transform(F.array(F.regexp_extract_all(text, pat, F.lit(0))), placed), F.lit(0))


def reference_kind(match: Column) -> Column:
    return (F.when(match.startswith("Fig"), "figure").when(match.startswith("Table"), "table")
            .when(match.startswith("Eq"), "equation").when(match.startswith("["), "citation").otherwise("section"))


def find_references(text: Column) -> Column:
    """Array of (kind, key, start, end); every number of a citation marker is its own pointer."""
    def numbers(m: Column) -> Column:
        inner = match_spans(m["text"], r"\d+(?:\.\d+)*")
        kind = reference_kind(m["text"])
        whole = F.array(F.struct(kind.alias("kind"), F.regexp_extract(m["text"], r"\d+(?:\.\d+)*", 0).alias("key"),
                                 m["start"].alias("start"), m["end"].alias("end")))
        each = F.transform(inner, lambda n: F.struct(kind.alias("kind"), n["text"].alias("key"),
                                                     (m["start"] + n["start"]).alias("start"), (m["start"] + n["end"]).alias("end")))
        return F.when(kind == "citation", each).otherwise(whole)

    return F.flatten(F.transform(match_spans(text, REFERENCE), numbers))


def ends_entry(line: Column) -> Column:
    """Lines that end a bibliography entry whatever stands before them."""
    return ends_trimmed(line).rlike(r"^$|^\d{1,4}$|^\[\d+\]")


def first_entry(text: Column) -> Column:
    """The first bibliography entry, its lines joined; a hyphen at a line end joins without a space."""
    # Leading blank lines go; the first line is always kept, later ones until one starts something else.
    body = F.regexp_replace(text, r"(?U)^(?:\s*\n)+", "")
    lines = F.transform(F.split(body, "\n"), ends_trimmed)
    init = F.struct(F.get(lines, F.lit(0)).alias("out"), F.get(lines, F.lit(0)).alias("prev"), F.lit(False).alias("stopped"))

    def step(acc: Column, line: Column) -> Column:
        another = ((line == "") | line.rlike(r"^\d{1,4}$") | line.rlike(r"^\[\d+\]")
                   | (line.rlike(r"^\p{Lu}[\p{L}'’-]+,\s") & acc["prev"].endswith(".")))
        stop = acc["stopped"] | another
        joined = F.concat(acc["out"], F.when(acc["out"].endswith("-"), F.lit("")).otherwise(F.lit(" ")), line)
        return F.struct(F.when(stop, acc["out"]).otherwise(joined).alias("out"), line.alias("prev"), stop.alias("stopped"))

    return F.aggregate(F.slice(lines, 2, F.size(lines)), init, step, lambda acc: acc["out"])


def dest_top(kind: Column, xyz_top: Column, height: Column) -> Column:
    """Page-space y of a link destination (its stored top is measured from the bottom), clamped to the page."""
    y = F.least(F.greatest(height - xyz_top, F.lit(0.0)), height)
    return F.when(kind.isin("XYZ", "FitH", "FitBH", "FitR") & xyz_top.isNotNull(), y)


def dest_left(kind: Column, left: Column) -> Column:
    return F.when(kind.isin("XYZ", "FitR"), left)


def escaped(text: Column) -> Column:
    """Markup characters of body text as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escaped_attr(text: Column) -> Column:
    return F.replace(F.replace(escaped(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
