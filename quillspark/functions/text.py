"""Text expressions (Column -> Column): tokens, stems, slugs, names, hashes. No Python runs on the executors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that term results are defined with.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have having "
    "he her here hers herself him himself his how i if in into is it its itself just like may me might more most "
    "much must my myself no nor not now of off on once only or other our ours ourselves out over own same she "
    "should so some such than that the their theirs them themselves then there these they this those through to "
    "too under until up us very was we were what when where which while who whom why will with would you your "
    "yours yourself yourselves one two get got make made use used using way well also e.g i.e etc via per "
    "note notes todo http https www com md"
).split()

# Greek letters in entity names and their Latin spellings.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa",
    "λ": "lambda", "μ": "mu", "σ": "sigma", "τ": "tau", "ω": "omega",
}

TOKEN = r"[a-z][a-z0-9\-']+"


def cut(w: Column, n: int) -> Column:
    """``w`` without its last ``n`` characters."""
    return F.substring(w, F.lit(1), F.length(w) - n)


def light_stem(w: Column) -> Column:
    """Plural and verb endings only; an ending applies if three characters stay, else the next one is tried."""

    def ends(suffix: str) -> Column:
        return w.endswith(suffix) & (F.length(w) >= len(suffix) + 3)

    sibilant = reduce(Column.__or__, [w.endswith(x) for x in ("ches", "shes", "xes", "zes")])
    return (
        F.when(ends("ies"), F.concat(cut(w, 3), F.lit("y")))
        .when(ends("sses"), cut(w, 2))
        .when(ends("ing"), cut(w, 3))
        .when(ends("edly"), cut(w, 4))
        .when(ends("ed"), cut(w, 2))
        .when(ends("es"), F.when(sibilant, cut(w, 2)).otherwise(cut(w, 1)))
        .when(ends("s"), cut(w, 1))
        .otherwise(w)
    )


def terms(text: Column) -> Column:
    """array<string>: lower-case words of three characters or more, without stop words, stemmed; repeats stay."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: F.btrim(w, F.lit("-'")))
    return F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)), light_stem)


#: Accented Latin letters and their plain ones, by canonical decomposition.
_ACCENTED = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
ACCENTS = ("".join(_ACCENTED), "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED))


def search_tokens(text: Column) -> Column:
    """array<string>: lower-case letter and digit runs without accents, as the search index has them."""
    return F.regexp_extract_all(F.translate(F.lower(text), *ACCENTS), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_]+", "-")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def strip(text: Column) -> Column:
    """Without white space (any, not only spaces) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def one_line(text: Column, n: int) -> Column:
    s = squeeze(text)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


def norm_name(name: Column) -> Column:
    """Key of an entity name: Greek letters spelt out, only a-z and 0-9 left."""
    s = reduce(lambda c, g: F.replace(c, F.lit(g[0]), F.lit(g[1])), GREEK.items(), F.lower(strip(name)))
    return F.regexp_replace(s, "[^a-z0-9]+", "")


def digest(text: Column, n: int) -> Column:
    """First ``n`` hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def content_hash(body: Column) -> Column:
    return digest(body, 16)


def passage_hash(text: Column) -> Column:
    return digest(F.lower(squeeze(text)), 16)


def identifier(prefix: str, *parts: Column) -> Column:
    """Stable short id; null parts count as empty, so that none slips its neighbours together."""
    return F.concat(F.lit(prefix), digest(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 10))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def study_id(doi: Column, pmid: Column, pmcid: Column, own: Column, label: Column, note: Column) -> Column:
    """The study that a note reports: an identifier if there is one, else its label, else the note itself."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(label), r"\([^)]*\)|\bet al\b\.?", " "), r"(?U)[^\w\s]", " ")
    key = slug(squeeze(plain))
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}:"), c)) for k, c in (("doi", doi), ("pmid", pmid), ("pmcid", pmcid), ("study_id", own))]
    return F.coalesce(*named, F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("study:"), key)), F.concat(F.lit("note:"), note))
