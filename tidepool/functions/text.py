"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content; fixed values.
STOPWORDS = tuple(
    """
    a an the this that these those and or but if then so of in on at to for with
    from by as is are was were be been being it its it's you your they their he
    she his her we our i my not no do does did will would can could should has
    have had also into about than more most such
    """.split()
)
#: Phrases of a model that declines; fixed values.
REFUSALS = ("i cannot", "i can't", "i'm unable", "as an ai", "i don't have enough information")


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Runs of non-space characters; Unicode white space separates."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    """How many words; null counts as none."""
    return F.coalesce(F.size(words(x)), F.lit(0)) if x is not None else F.lit(0)


def char_length(x: Column) -> Column:
    return F.coalesce(F.length(x), F.lit(0))


def normalized_title(x: Column) -> Column:
    """Lower case, other than a-z and 0-9 as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def clipped(x: Column, n: int) -> Column:
    """The first n characters after stripping."""
    return F.substring(strip(x), 1, n)


def populated(x: Column, kind: str) -> Column:
    """Whether a value says something: not null, not blank, not an empty list."""
    if kind == "string":
        return F.coalesce(F.length(strip(x)) > 0, F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull()


def stratify_key(*parts: Column) -> Column:
    """Parts joined by a bar; flags must be integers already."""
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def description(summary: Column, storyline: Column) -> Column:
    """Summary and storyline with a blank line between; null where both are blank."""
    full = lambda x: F.when(F.length(strip(x)) > 0, strip(x))
    text = F.concat_ws("\n\n", full(summary), full(storyline))
    return F.when(F.length(text) > 0, text)


def plain_words(x: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))


def content_words(x: Column, least: int = 4) -> Column:
    """Distinct plain words of at least ``least`` characters that are no stopwords."""
    return F.array_distinct(F.filter(plain_words(x), lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))


def overlap_ratio(claim: Column, source: Column) -> Column:
    """The share of the claim's content words that are words of the source; 1 where the claim has none."""
    a, b = content_words(claim), F.array_distinct(plain_words(source))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def degenerate(x: Column) -> Column:
    """Empty, a refusal, or one word more than half of six or more."""
    low = F.lower(strip(F.coalesce(x, F.lit(""))))
    w = plain_words(low)
    refuses = F.lit(False)
    for phrase in REFUSALS:
        refuses = refuses | F.contains(low, F.lit(phrase))
    middle = F.get(F.sort_array(w), F.floor(F.size(w) / 2).cast("int"))  # a word of more than half is also the middle one
    most = F.size(w) - F.size(F.array_remove(w, middle))
    return (F.length(low) == 0) | refuses | ((F.size(w) >= 6) & (F.coalesce(most, F.lit(0)) * 2 > F.size(w)))


def _has_word(text: Column, term: Column) -> Column:
    """Whether ``text`` holds ``term`` with no letter or digit on either side, ignoring case."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(term), "[^a-z0-9]+", " ")), F.lit(" ")))


def ungrounded(text: Column, vocabulary: Column, allowed: Column) -> Column:
    """Terms of the vocabulary, in its order, that the text names and that are not allowed."""
    low = F.transform(allowed, lambda t: F.lower(t))
    return F.filter(vocabulary, lambda t: _has_word(text, t) & ~F.array_contains(low, F.lower(t)))


def without_fence(x: Column) -> Column:
    """The inside of a fenced code block, or the text itself."""
    return strip(F.regexp_replace(strip(x), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def judged(x: Column, keys: tuple[str, ...], low: int = 1, high: int = 5) -> Column:
    """Scores from a judge's JSON answer: a struct of ints, null where a key is missing or out of range."""
    parsed = F.from_json(without_fence(x), "struct<" + ",".join(f"{k}:int" for k in keys) + ">")
    valid = F.lit(True)
    for k in keys:
        valid = valid & F.coalesce(parsed[k].between(low, high), F.lit(False))
    return F.when(valid, parsed)


def ranked_ids(x: Column, candidates: Column, k: int) -> Column:
    """A model's list of ids: the first k if all are distinct candidates and at least min(k, candidates) are given, else null."""
    ids = F.from_json(without_fence(x), "array<bigint>")
    valid = (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(ids, candidates)) == 0) & (F.size(ids) >= F.least(F.lit(k), F.size(candidates)))
    return F.when(valid, F.slice(ids, 1, k))
