"""Text columns: tokens, keys, folding, the prose predicate. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of clean prose, as the inside of a character class.
ALLOWED = {
    "de": "\\w \\-–—.,;:!?'\"„“”‚‘’()§%&/+°ÄÖÜäöüß€$",
    "es": "\\w \\-–—.,;:!?¿¡'\"“”‘’«»()%&/+°ºªÁÉÍÓÚÑÜáéíóúñü€$",
}

# Substrings of web furniture.
JUNK = ("http", "www.", "@", "|", "©", "...", "…", "[", "]", "<", ">")

# Paired characters that must balance.
PAIRS = {
    "de": (('"', '"'), ("(", ")"), ("„", "“")),
    "es": (('"', '"'), ("(", ")"), ("«", "»"), ("“", "”"), ("‘", "’")),
}

#: White space as Python's ``str.split`` knows it.
_SPACE = "(?U)[\\s\\x1c-\\x1f]+"


def tokens(text: Column) -> Column:
    """Words apart by Unicode white space; none of them empty."""
    return F.array_remove(F.split(text, _SPACE), "")


def normalise(text: Column) -> Column:
    """A key that doesn't depend on tokenisation: no white space, lower case."""
    return F.lower(F.regexp_replace(text, _SPACE, ""))


def occurrences(text: Column, part: str) -> Column:
    """How often one character stands in a text."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))


def is_clean(text: Column, language: str) -> Column:
    """Whether a sentence looks like whole prose: starts without a lower-case letter,
    ends in ``.!?``, has no junk, only allowed characters, isn't in capitals, and its
    pairs balance. Null and empty texts aren't clean."""
    first, last = F.substring(text, 1, 1), F.right(text, F.lit(1))
    lower = (first == F.lower(first)) & (first != F.upper(first))
    ok = (text != "") & ~lower & last.isin(".", "!", "?")
    for junk in JUNK:
        ok = ok & ~F.contains(text, F.lit(junk))
    ok = ok & text.rlike(f"(?U)^[{ALLOWED[language]}]+$")
    ok = ok & ~((text == F.upper(text)) & (text != F.lower(text)))
    for left, right in PAIRS[language]:
        ok = ok & ((occurrences(text, left) % 2 == 0) if left == right else (occurrences(text, left) == occurrences(text, right)))
    return F.coalesce(ok, F.lit(False))


# Typeset characters and the keyboard's for them.
TYPESET, TYPED = "’‘“”„–—\u00a0", "''\"\"\"-- "


def typographic(text: Column) -> Column:
    """Curly quotes, dashes and no-break spaces folded to plain ones, white space to one
    space, of composed text: a text that may not be (NFC) goes through ``kernels.nfc``
    before, which ``leniency.folded`` does."""
    return F.trim(F.regexp_replace(F.translate(text, TYPESET, TYPED), _SPACE, " "))


def same_compound(gold: Column, hypothesis: Column) -> Column:
    """Whether two words differ only in a hyphen and case, one closed and one hyphenated,
    whatever dash that is."""
    gold, hypothesis = typographic(gold), typographic(hypothesis)
    hyphen = lambda c: F.contains(c, F.lit("-"))
    squash = lambda c: F.lower(F.replace(c, F.lit("-"), F.lit("")))
    spaced = F.contains(gold, F.lit(" ")) | F.contains(hypothesis, F.lit(" "))
    return ~spaced & (hyphen(gold) != hyphen(hypothesis)) & (squash(gold) == squash(hypothesis))


def squash(words: Column) -> Column:
    """Tokens in lower case without anything between."""
    return F.lower(F.array_join(words, ""))


def squash_marks(words: Column) -> Column:
    """The same without apostrophes and hyphens."""
    return F.regexp_replace(squash(words), "['-]", "")


def same_spelling(a: Column, b: Column, language: str = "de") -> Column:
    """Whether two token arrays are one text but for case and spaces, in Spanish but for
    stress marks too."""
    fold = unstressed if language == "es" else (lambda c: c)
    return fold(squash(a)) == fold(squash(b))


def straight_quotes(text: Column) -> Column:
    """Straight double quotes set tight to what they hold: the odd ones open, the even ones
    close; an unpaired last one stays as it is."""
    parts = F.split(text, '"', -1)
    paired = F.when(F.size(parts) % 2 == 1, F.size(parts)).otherwise(F.size(parts) - 1)
    inner = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < paired), F.trim(p)).otherwise(p))
    return F.array_join(inner, '"')


def space_before(words: Column) -> Column:
    """Whether a space stands before each token in display form."""
    closing = lambda w: w.rlike("^[.,;:!?…)\\]}»”]+$")
    opening = lambda w: w.rlike("^[(\\[{¿¡«„]+$")
    return F.transform(words, lambda w, i: (i > 0) & ~closing(w) & ~F.coalesce(opening(F.get(words, i - 1)), F.lit(False)))


def tokenize(text: Column) -> Column:
    """The fallback tokenizer: punctuation before white space or the end stands apart."""
    return F.regexp_replace(text, "([.,;:!?…])(\\s|$)", " $1$2")


def detokenize(text: Column) -> Column:
    """Display form: no space before closing punctuation, none after an opening bracket."""
    return F.regexp_replace(F.regexp_replace(text, " +([.,;:!?…)])", "$1"), "([(¿¡]) +", "$1")


def unstressed(text: Column) -> Column:
    """Lower case without Spanish stress marks; ñ and ü stay."""
    return F.translate(F.lower(text), "áéíóú", "aeiou")


def assign_split(key: Column, salt: str, train: float = 0.8, dev: float = 0.1) -> Column:
    """A split by the SHA-256 of ``salt:key``: its first 13 hexadecimal digits as a share
    of their range against the cumulative ratios."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    return F.when(share < train, "train").when(share < train + dev, "dev").otherwise("test")
