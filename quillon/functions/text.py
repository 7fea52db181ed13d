"""Analyzers: a text column to an array of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from quillon.functions.porter import porter_all

# English stop words.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you "
    "your yours yourself yourselves"
).split()
TERM = "[a-z0-9à-ÿ]+"


def tokens(text: Column | str, stop: bool = True) -> Column:
    """Lower-cased terms in order, repeats kept; stop words left out if `stop`. Null text gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOPWORDS)) if stop else found


def words(text: str) -> Column:
    """Lower-cased words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")


def stem(term: Column) -> Column:
    """A light English stemmer as an expression: plural, -ing and -ed endings."""
    return (
        F.when(term.rlike("(ss|us|is)$"), term)
        .when(term.rlike("ies$") & (F.length(term) > 4), F.regexp_replace(term, "ies$", "y"))
        .when(term.rlike("(ch|sh|x|s|z)es$"), F.regexp_replace(term, "es$", ""))
        .when(term.rlike("[a-z]{3,}ing$"), F.regexp_replace(term, "ing$", ""))
        .when(term.rlike("[a-z]{3,}ed$"), F.regexp_replace(term, "ed$", ""))
        .when(term.rlike("[^s]s$") & (F.length(term) > 3), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )


# The stop words of the English analyzer of a widespread search library.
SEARCH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# The Penn Treebank tokenizer's rules, in order.
TREEBANK = [
    (r'^"', "`` "), (r"(``)", " $1 "), (r'([ (\[{<])("|\'\')', "$1 `` "),
    (r"([:,])([^0-9])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", " $1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "), (r"--", " -- "), (r'"', " '' "), (r"([^\s])('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(d)('ye)\b", "$1 $2"), (r"(?i)\b(gim)(me)\b", "$1 $2"), (r"(?i)\b(gon)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"), (r"(?i)\b(lem)(me)\b", "$1 $2"), (r"(?i)\b(more)('n)\b", "$1 $2"), (r"(?i)\b(wan)(na)\b", "$1 $2"),
]
ENDINGS = 12  # the first rule for endings


def treebank(text: str) -> Column:
    """Penn Treebank tokens of one sentence, case kept: punctuation and clitics are tokens, opening and closing quotes differ."""
    found = F.coalesce(F.col(text), F.lit(""))
    for i, (pattern, out) in enumerate(TREEBANK):
        if i == ENDINGS:  # the rules for endings look for a space on either side
            found = F.concat(F.lit(" "), found, F.lit(" "))
        found = F.regexp_replace(found, pattern, out)
    return F.filter(F.split(found, r"\s+"), lambda x: x != "")


def english(text: str) -> Column:
    """Lower-cased terms without possessive endings and the search library's stop words, Porter-stemmed."""
    body = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "['’]s\\b", "")
    return porter_all(F.filter(F.regexp_extract_all(body, F.lit(TERM), F.lit(0)), lambda x: ~x.isin(SEARCH_STOP)))


def stemmed(text: str) -> Column:
    """Lower-cased terms without stop words, Porter-stemmed."""
    return porter_all(tokens(text))


ANALYZERS = {
    "plain": lambda c: tokens(c, stop=False),
    "stop": tokens,
    "stem": lambda c: F.transform(tokens(c), stem),
    "words": words,
    "treebank": lambda c: F.filter(F.transform(treebank(c), F.lower), lambda x: x.rlike("[a-z0-9à-ÿ]") & ~x.isin(STOPWORDS)),
    "english": english,
    "porter": stemmed,
}


def falsy(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def titled(title: str, text: str, sep: str = "\n") -> Column:
    """Title and text, the separator only between two that are not empty."""
    return F.concat_ws(sep, *(F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in (title, text)))
