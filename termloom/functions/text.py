"""Text normalisation, stemming, tokens and phrase keys.

Each function builds a Column from built-in expressions, so that it stays inside
generated code. Only Unicode compatibility folding, casefolding and the code-page
test have no built-in form; those are vectorised pandas UDFs and apply on request.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, StringType

from .values import BRITISH, CJK, CJK_COMPATIBILITY, STOP_WORDS, ZH_STANDARD, ZH_VARIANTS


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def dedup_key(s: pd.Series) -> pd.Series:
    """Compatibility-folded, white space squeezed, casefolded."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


def _traditional(text: str, lang: str | None) -> bool:
    han = [c for c in text if "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"]
    if lang and lang != "zh":
        return bool(han) if lang.startswith("zh") else True
    try:
        "".join(han).encode("cp950")
    except UnicodeEncodeError:
        return False
    return True


@F.pandas_udf(BooleanType())
def traditional(text: pd.Series, lang: pd.Series) -> pd.Series:
    """Chinese that a traditional code page can hold: for language ``zh`` every
    character must encode; other ``zh-*`` need one Chinese character."""
    return pd.Series([None if t is None else _traditional(t, g) for t, g in zip(text, lang)], dtype=object)


def clean(s: Column) -> Column:
    """White space squeezed and trimmed, canonical composition."""
    return F.trim(F.regexp_replace(nfc(s), r"\s+", " "))


def american(s: Column) -> Column:
    """British spellings as American; the look-behind keeps angioedema."""
    for british, us in BRITISH:
        s = F.regexp_replace(s, british, us)
    return s


def normalise(s: Column, fold: bool = True) -> Column:
    """Lower case, standard variants, no possessives, American spelling, letters
    and digits only (a dot stays between digits), single spaces. Compatibility folding
    comes first and needs a vectorised UDF; text known to be ASCII is unchanged by it
    and can do without (``fold`` false)."""
    t = F.lower(nfkc(s) if fold else s)
    t = F.translate(t, ZH_VARIANTS, ZH_STANDARD)
    t = F.regexp_replace(t, r"['’]s(?![A-Za-z0-9_])", "")
    t = american(t)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s.]", " ")
    t = F.regexp_replace(t, r"(?<![0-9])\.|\.(?![0-9])", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def stem(w: Column) -> Column:
    """Plural endings only; short words and words with digits stay."""
    n, two = F.length(w), F.substring(w, -2, 2)
    sibilant = w.endswith("ches") | w.endswith("shes") | w.endswith("xes") | w.endswith("zes")
    return (
        F.when(~w.endswith("s") | (n <= 3) | w.rlike("[0-9]"), w)  # most words end here, without a pattern
        .when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(two.isin("ss", "us", "is", "as", "os"), w)
        .when(sibilant, F.substring(w, F.lit(1), n - 2))
        .otherwise(F.substring(w, F.lit(1), n - 1))
    )


def english(t: Column) -> Column:
    """Stemmed English words of a normalised text, stop words dropped, in order."""
    spaced = F.regexp_replace(t, f"[{CJK}]+", " ")
    stops = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(F.split(spaced, " "), lambda w: (w != "") & ~F.array_contains(stops, w))
    return F.transform(kept, stem)


def han_runs(t: Column) -> Column:
    """Runs of Chinese characters of a normalised text, in order."""
    return F.regexp_extract_all(t, F.lit(f"([{CJK}]+)"), F.lit(1))


def bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a single character is itself."""
    n = F.length(run)
    return F.when(n < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def gap_bigrams(run: Column) -> Column:
    """Pairs of characters with one between them."""
    n = F.length(run)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat(F.substring(run, i, F.lit(1)), F.substring(run, i + 2, F.lit(1))))
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(pairs)


def tokens(t: Column) -> Column:
    """Index and query tokens of a normalised text, with repeats."""
    return F.concat(english(t), F.flatten(F.transform(han_runs(t), bigrams)))


def phrase_key(t: Column) -> Column:
    """The text's set of words, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(english(t), han_runs(t)))), " ")


def compatibility_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{CJK_COMPATIBILITY}]"))


def core_title(en: Column) -> Column:
    """A title without its closing ``, unspecified`` or ``NEC``, for glossary joins."""
    return F.lower(F.trim(F.regexp_replace(en, r"(?i)(,? (unspecified|not elsewhere classified|NEC|NOS))+$", "")))


def strip_snomed_tail(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?i)\s*\((disorder|finding|morphologic abnormality|procedure|situation|event|qualifier value)\)$", ""))


def is_abbreviation(s: Column) -> Column:
    return s.rlike("^[A-Z]{2,5}$")


def term_ok(s: Column, longest: int = 200) -> Column:
    t = trim_term(s)
    return (F.length(t) > 0) & (F.length(t) <= longest)


def trim_term(s: Column) -> Column:
    return F.btrim(s, F.lit(" ,;"))


def repair_garbled(zh: Column, en: Column) -> Column:
    """A lost character before 管 is restored where the English says fistula."""
    return F.when(zh.contains("?管") & F.lower(en).contains("fistula"), F.replace(zh, F.lit("?管"), F.lit("廔管"))).otherwise(zh)


def is_garbled(zh: Column) -> Column:
    return zh.contains("?") | zh.contains("�")


def term_variants(path: Column) -> Column:
    """Forms of an index path (array of headings): comma form, natural order for
    two levels, and the bare head for one."""
    n = F.size(path)
    comma = F.array_join(path, ", ")
    return F.array_distinct(F.when(n == 2, F.array(comma, F.concat_ws(" ", path[1], path[0]))).otherwise(F.array(comma)))
