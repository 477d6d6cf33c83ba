"""Text columns: missing values, cleaning, tokens, labels, ids. All are built-in expressions.

Patterns start with ``(?Ud)`` where a class or line end must mean what Unicode says, not ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(c: Column) -> Column:
    """True unless null, blank, or the word ``nan`` or ``none``."""
    return F.coalesce(~F.lower(F.trim(c)).isin("", "nan", "none"), F.lit(False))


def present(c: Column) -> Column:
    """The value, or null where it is missing by ``nonempty``."""
    return F.when(nonempty(c), c)


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "t"), F.lit(False))


def tokens(c: Column) -> Column:
    """White-space tokens; none for a blank or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


# The edits that make comments comparable, in their order.
COMMENT_EDITS = [
    (r"\f", " "),
    (r"-\n", ""),
    (r"<<COMMENT \d+>>", ""),
    (r"<<PAGE \d+>>", ""),
    (r"(?i)^\s*(true|false)\s*\d+\s*", ""),
    (r"(?im)^\s*see\s+attached\s*$", ""),
    (r"(?m)^.*\d+\s+\d+\w*\s+Street.*$", ""),
    (r"(?m)^.*,\s*(VA|DC|NM|WV)\s+\d{5}.*$", ""),
    (r"(?m)^.*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}.*$", ""),
    (r"(?im)^VIA\s+.*$", ""),
    (r"(?im)^RE:.*$", ""),
    (r"(?im)^Docket.*$", ""),
    (r"(?i)dear\s+[\w\s.,/]+[,:]\s*", ""),
    (r"(?is)(sincerely|respectfully|regards|thank you)[\s,].*$", ""),
    (r"(?i)mine safety and health administration['’]?s?\s*\(MSHA( or Administration)?\)", ""),
    (r"(?im)^(From|Sent|To|Cc|Subject|Attachments):\s*.*$", ""),
    (r"https?://\S+", ""),
    (r"(?i)doi:\S+", ""),
    (r"(?i)\d+\s+Fed\.?\s*Reg\.?\s*\d+", ""),
    (r"(?i)\d+\s+C\.?F\.?R\.?\s*§?\s*\d+", ""),
    (r"\(\w+\s+\d{1,2},?\s+\d{4}\)", ""),
    (r"(?i)^(comment\s+(from|by|submitted).*?(received|dated).*?\d{4})\s*", ""),
    (r"\n", " "),
    (r"\s+", " "),
]
# The edits for register notices.
REGISTER_EDITS = [
    (r"<<COMMENT \d+>>\s*", ""),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?Z?\s*", ""),
    (r"(?m)^\s*(true|false)\s*$", ""),
    (r"(?m)^\s*\d+\s*$", ""),
    (r"Federal Register,?\s*Volume\s+\d+\s+Issue\s+\d+\s*\([^)]+\)\s*", ""),
    (r"\[Federal Register Volume \d+, Number \d+ \([^)]+\)\]", ""),
    (r"\[FR Doc\.[^\]]*\]", ""),
    (r"\n{3,}", "\n\n"),
]


def _edited(c: Column, edits: list[tuple[str, str]]) -> Column:
    for pattern, by in edits:
        c = F.regexp_replace(c, "(?Ud)" + pattern, by)
    return c


def clean_comment(c: Column) -> Column:
    """Comparable form of a comment: markers, letterheads, greetings and links removed, lower case."""
    return F.lower(F.trim(_edited(F.coalesce(c, F.lit("")), COMMENT_EDITS)))


def clean_register(c: Column) -> Column:
    """A register notice without markers, stray dates, numbers and headers; empty for missing texts."""
    return F.when(nonempty(c), F.regexp_replace(_edited(c, REGISTER_EDITS), r"(?U)^\s+|\s+$", "")).otherwise("")


def structured_notice(title: Column, text: Column, cap: int = 2000) -> Column:
    """Title, SUMMARY and ACTION of a notice; where these look like scanning noise, a stretch of the text instead.

    Noise: of the first 30 words more than 5, and more than 40 %, have at most two letters. The
    stretch is the first 2000 characters behind the first line end from character 700 on, up to 2700.
    """
    clean = clean_register(text)
    summary = F.trim(F.regexp_extract(clean, r"(?Usd)SUMMARY:\s*(.*?)(?=\n\s*\n|\b(?:DATES|ADDRESSES|ACTION|FOR FURTHER INFORMATION CONTACT):|\z)", 1))
    action = F.trim(F.regexp_extract(clean, r"(?Usd)ACTION:\s*(.*?)(?=\n\s*\n|\b(?:SUMMARY|DATES|ADDRESSES|FOR FURTHER INFORMATION CONTACT):|\z)", 1))
    first = F.slice(tokens(summary), 1, 30)
    short = F.size(F.filter(first, lambda w: F.length(w) <= 2))
    noisy = (short > 5) & (short > F.size(first) * 0.4)
    good = F.when(noisy, "").otherwise(summary)
    window = F.substring(clean, 701, 2000)
    at = F.locate("\n", window)
    stretch = F.when(at > 0, F.substring(window, at + 1, F.length(window))).otherwise(window)
    body = F.when((good == "") & (action == ""), stretch).otherwise(F.array_join(F.filter(F.array(good, action), lambda x: x != ""), "\n"))
    return F.substring(F.array_join(F.filter(F.array(F.coalesce(F.trim(title), F.lit("")), body), lambda x: x != ""), "\n"), 1, cap)


def assemble(pieces: Column) -> Column:
    """Numbered pieces of an ordered list, blank ones left out."""
    kept = F.filter(pieces, lambda p: F.coalesce(F.trim(p) != "", F.lit(False)))
    return F.array_join(F.transform(kept, lambda p, i: F.concat(F.lit("<<COMMENT "), (i + 1).cast("string"), F.lit(">>\n"), p)), "\n")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def without_suffixes(c: Column) -> Column:
    return F.regexp_replace(c, r"(\.(txt|html?|pdf))+$", "")


def split_cell(c: Column, by: str = ",") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")


def url_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[|\n,;\s]+"), lambda x: x.rlike(r"^https?://")))


def last_page(c: Column) -> Column:
    """The largest page marker; 1 for a text without one, 0 for none."""
    pages = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"<<PAGE (\d+)>>"), 1), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(pages), F.when(nonempty(c), 1).otherwise(0))


def reverified(text: Column, partial: Column, least: int = 0, enabled: bool = True) -> Column:
    """Is a stored text to be fetched again? Always if there is none or only a part of it, else if its last page marker reaches the least; 0 means any."""
    if not enabled:
        return F.lit(False)
    return F.coalesce(partial, F.lit(False)) | ~nonempty(text) | (F.lit(least <= 0) | (last_page(text) >= least))


def yes_no(c: Column) -> Column:
    """``yes`` or ``no`` if the answer's first word begins so, else empty."""
    word = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[^a-z]*([a-z]+)", 1)
    return F.when(word.startswith("yes"), "yes").when(word.startswith("no"), "no").otherwise("")


PAIR_LABELS = ["same", "related", "opposing", "different"]


def batch_labels(c: Column, n: Column, vocabulary: list[str] = PAIR_LABELS) -> Column:
    """The vocabulary's words in order, padded with ``error`` or cut to n."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z_]+)"), 1), lambda w: w.isin(*vocabulary))
    return F.slice(F.concat(words, F.array_repeat(F.lit("error"), n)), F.lit(1), n)


def claim_tags(c: Column, n: Column) -> Column:
    """(provision, claim) of each line ``[P#] claim`` whose number is from 1 to n."""
    text, line = F.coalesce(c, F.lit("")), F.lit(r"(?m)^\s*\[P(\d{1,9})\][ \t]*(\S[^\n]*)$")
    pairs = F.arrays_zip(F.regexp_extract_all(text, line, 1).alias("p"), F.regexp_extract_all(text, line, 2).alias("t"))
    found = F.transform(pairs, lambda x: F.struct(x["p"].cast("int").alias("provision"), F.trim(x["t"]).alias("claim")))
    return F.filter(found, lambda x: x["provision"].between(1, n))


def claim_lines(c: Column) -> Column:
    """How many lines look like claims, whatever their number."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?m)^\s*\[P\d+\]"))


def numbered(items: Column) -> Column:
    """One line ``n. item`` for each item."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def prefix_key(c: Column, n: int = 200) -> Column:
    return F.lower(F.trim(F.substring(c, 1, n)))


def pair_key(doc_id: Column, response: Column) -> Column:
    return F.concat_ws("||", F.coalesce(doc_id.cast("string"), F.lit("")), F.substring(F.coalesce(response, F.lit("")), 1, 200))


def head_and_tail(c: Column, head: int, tail: int, joiner: str = " [...] ") -> Column:
    """All tokens, or the first and last ones around a mark if there are too many."""
    own = tokens(c)
    cut = F.concat(F.array_join(F.slice(own, 1, head), " "), F.lit(joiner), F.array_join(F.slice(own, -tail, tail), " "))
    return F.when(F.size(own) > head + tail, cut).otherwise(F.array_join(own, " "))


def first_year(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(\d{4})\b", 1).try_cast("int")


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles and tags removed, runs of blank lines shortened."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(by))
    text = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def href(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"""(?i)href\s*=\s*["']([^"']*)["']""", 1)


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller token set that is in the other."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least), F.lit(0.0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)


def copy_unescaped(c: Column) -> Column:
    """A field of a COPY block: \\N is null, backslash escapes are resolved."""
    held = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for code, by in (("b", "\b"), ("f", "\f"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("v", "\v")):
        held = F.replace(held, F.lit("\\" + code), F.lit(by))
    return F.when(c == "\\N", F.lit(None).cast("string")).otherwise(F.replace(held, F.lit("\u0000"), F.lit("\\")))


def submission_mode(comment: Column, content: Column, attachments: Column) -> Column:
    typed, filed = nonempty(comment), nonempty(content) | nonempty(attachments)
    return F.when(typed & filed, "text_plus_attachment").when(typed, "text_only").when(filed, "attachment_only").otherwise("unknown")


def display_name(c: Column) -> Column:
    """organisation, name and format of ``Org, Name (FMT)``; an ``et al.`` doesn't end the organisation."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r",\s*et\.?\s+al\.?\s*,?", " et al")
    kind = F.regexp_extract(clean, r"\(([^()]*)\)\s*$", 1)
    rest = F.trim(F.regexp_replace(clean, r"\s*\([^()]*\)\s*$", ""))
    org = F.when(F.locate(",", rest) > 0, F.trim(F.regexp_extract(rest, r"^(.*),[^,]*$", 1))).otherwise("")
    name = F.trim(F.regexp_extract(rest, r"([^,]*)$", 1))
    return F.struct(org.alias("org"), name.alias("name"), kind.alias("format"))


def records(c: Column, pattern: str, groups: int) -> Column:
    """The groups of each match of a pattern, in order, as arrays: records that repeat in a page."""
    found = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), i + 1) for i in range(groups)]
    return F.transform(found[0], lambda _, i: F.transform(F.array(*found), lambda g: F.get(g, i)))


def without_surrogates(c: Column) -> Column:
    """Escaped halves of surrogate pairs that stand alone are dropped; a text of Spark's holds no real ones."""
    return F.regexp_replace(c, r"(?i)(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}|\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})", "")
