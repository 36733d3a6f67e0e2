"""Column-level text functions (T1-T6). All are built-in Spark expressions: no Python UDF.

Every function takes and returns a ``Column`` so it can be used inside ``select`` and keeps the
work inside the JVM.  The DuckDB twins of these expressions live in ``postcred.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# English stop words (the public NLTK English list, 179 entries, in its published order).
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn "
    "didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn "
    "mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't "
    "wouldn wouldn't"
).split()
# Characters Python's str.split() treats as whitespace (Java's \s covers only the ASCII ones).
WHITESPACE_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same whitespace characters as a plain string (for trim).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The 32 ASCII punctuation characters of Python's string.punctuation.
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# URL pattern of the reference's Find(); Python's \w is written out as letters, digits and '_'.
URL_PATTERN = r"(?:(?:https?|ftp)://)?[\p{L}\p{N}_/\-?=%.]+\.[\p{L}\p{N}_/\-?=%.]+"
# The 32 ASCII punctuation characters (Python's string.punctuation == POSIX punct).
PUNCT_PATTERN = r"\p{Punct}"
# Characters that are neither letters nor digits (Python's isalnum, Unicode aware).
NON_ALNUM_PATTERN = r"[^\p{L}\p{N}]"
DIGITS_ONLY_PATTERN = r"^\p{Nd}+$"
# Word pattern used by the lexicon scorers (sentiment, subjectivity, categories).
LEXICON_WORD_PATTERN = r"[\p{L}\p{N}_']+"
# ---------------------------------------------------------------------------------------------

WS_RUN = WHITESPACE_CLASS + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trim every Unicode whitespace character on both ends."""
    return F.trim(_col(c), F.lit(WHITESPACE_CHARS))


def split_ws(c) -> Column:
    """Python ``str.split()``: split on runs of Unicode whitespace, no empty tokens."""
    return F.filter(F.split(_col(c), WS_RUN), lambda t: t != F.lit(""))


def clean_tokens(c, stopwords: Iterable[str] | None = None) -> Column:
    """Text -> cleaned token array, in the reference's exact step order.

    1. split on whitespace; 2. drop a token whose lower case is a stop word (before punctuation
    removal); 3. lower + delete ASCII punctuation; 4. keep if longer than 2, not all digits and
    not containing ``https``; 5. delete every non-alphanumeric character (may leave ``''``).

    The text is lowered and stripped of signs as a whole, and only the two filters run token by token: white space, at which
    tokens are cut, is never changed by either.
    """
    sw = list(ENGLISH_STOPWORDS if stopwords is None else stopwords)
    toks = F.split(F.lower(_col(c)), WS_RUN)
    if sw:
        # More than 10 literals: the optimizer turns this IN into a hash-set lookup.
        toks = F.filter(toks, lambda t: ~t.isin(sw))
    toks = F.split(F.translate(F.array_join(toks, " "), PUNCT_CHARS, ""), " ")
    toks = F.filter(  # empty tokens go here too; one that begins with a-z is not all digits
        toks,
        lambda t: (F.length(t) > 2) & (((t >= "a") & (t < "{")) | ~t.rlike(DIGITS_ONLY_PATTERN)) & ~t.contains("https"),
    )
    # a mark in front keeps no tokens (none left) apart from one empty token
    whole = F.array_join(F.concat(F.array(F.lit("x")), toks), " ")
    return F.slice(F.split(F.regexp_replace(whole, NON_ALNUM_PATTERN[:-1] + " ]+", ""), " "), 2, 2147483647)


def clean_text(tokens) -> Column:
    """Cleaned tokens joined by one space."""
    return F.array_join(_col(tokens), " ")


def strip_urls(c) -> Column:
    """Delete URL-like substrings (also hits ``e.g`` and ``wait...``)."""
    return F.regexp_replace(_col(c), URL_PATTERN, "")


def strip_mentions(c) -> Column:
    """T4 (policy ``strip``): drop whitespace words containing ``@`` and re-join with one space."""
    words = F.filter(split_ws(c), lambda w: ~w.contains("@"))
    return F.array_join(words, " ")


def has_embedded_mention(c) -> Column:
    """True when a whitespace word other than a bare ``@`` contains ``@``.

    Policy ``drop_row`` of T4 drops such rows, which is what the reference ends up doing.
    """
    return F.exists(split_ws(c), lambda w: w.contains("@") & (w != F.lit("@")))


def strip_newlines(c) -> Column:
    """The stored text has ``\\n`` deleted (words on both sides fuse)."""
    return F.replace(_col(c), F.lit("\n"), F.lit(""))


def lexicon_words(c) -> Column:
    """Lower-cased word runs used to look tokens up in a lexicon."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(LEXICON_WORD_PATTERN), 0)
