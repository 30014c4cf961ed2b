"""Column expressions that clean and normalise text."""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs() -> tuple[str, str]:
    """Accented letters and what is left of them, from Unicode's own decompositions."""
    letters = [chr(c) for c in range(0xC0, 0x250)]
    kept = [(c, d[0]) for c in letters if (d := unicodedata.normalize("NFKD", c)) != c and d[0].isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTED, PLAIN = _pairs()


def _folds() -> tuple[str, str, dict[str, str]]:
    """What NFKC and full case folding make of small letters and other signs: one character of one, and the rest.

    The rest are characters that become several ("ß", ligatures, fractions), and letters with marks of their own, which
    become one. Hangul syllables put together of their parts aren't among them.
    """
    folded = lambda c: unicodedata.normalize("NFKC", c).casefold()
    ranges = itertools.chain(range(0x80, 0xD800), range(0xE000, 0x10000), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200), range(0x2F800, 0x2FA20))
    every = {c: folded(c) for c in map(chr, ranges) if unicodedata.category(c) != "Cn"}
    one = {c: f for c, f in every.items() if f != c and c.lower() == c and len(f) == 1}
    rest = {c: f for c, f in every.items() if len(f) > 1 and len(c.lower()) == 1}
    for c in every:
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.category(apart[1]) == "Mn" and unicodedata.normalize("NFC", apart) == c:
            rest[apart.lower()] = every[c]
    return "".join(one), "".join(one.values()), rest


FOLDED_FROM, FOLDED_TO, FOLDS = _folds()


def _ranges(chars: list[str]) -> str:
    """The characters as ranges of a pattern's class."""
    runs = itertools.groupby(enumerate(sorted(map(ord, chars))), lambda x: x[1] - x[0])
    ends = [(run[0][1], run[-1][1]) for run in (list(r) for _, r in runs)]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ends)


#: Characters that ``FOLDS`` may concern: those that become several, and marks.
FOLD_HINT = "[" + _ranges([c for c in FOLDS if len(c) == 1]) + r"\p{M}]"


def case_folded(text: Column) -> Column:
    """NFKC and full case folding, by tables made of Unicode's own; ASCII texts pass none, those without a rare sign only that of single characters."""
    lower = F.translate(F.lower(text), FOLDED_FROM, FOLDED_TO)
    known = F.from_json(F.lit(json.dumps(FOLDS)), "map<string,string>")
    parts = F.regexp_extract_all(lower, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    several = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), F.concat(F.coalesce(F.try_element_at(known, F.left(p, F.lit(1))), F.left(p, F.lit(1))), F.substr(p, F.lit(2))))), "")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), F.lower(text)).when(lower.rlike(FOLD_HINT), several).otherwise(lower)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it, also in lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def unaccented(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(text, ACCENTED, PLAIN)


def title_words(title: Column) -> Column:
    """A title folded by compatibility and case, with & spelled out and other signs as single spaces."""
    spelled = F.replace(case_folded(title), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def title_ascii(title: Column) -> Column:
    """A title as unaccented ASCII words; marks that stand as characters of their own go, ligatures count as their letters."""
    plain = F.regexp_replace(unaccented(title), r"\p{M}+", "")
    for ligature in "\ufb00\ufb01\ufb02\ufb03\ufb04":
        plain = F.replace(plain, F.lit(ligature), F.lit(unicodedata.normalize("NFKC", ligature)))
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))


def token_set(words: Column) -> Column:
    """Distinct words of a space-separated text."""
    return F.array_distinct(F.filter(F.split(words, " "), lambda w: w != ""))


def strip_markup(text: Column) -> Column:
    """Without scripts, styles and tags; common entities decoded; white space single."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Labels that open an abstract, and what stands in place of a missing one.
ABSTRACT_LABELS = ("abstract", "summary", "resumo")
NO_ABSTRACT = ("not available", "unavailable", "não disponível", "não informado")


def clean_abstract(text: Column, least: int = 20, most: int = 50_000) -> Column:
    """An abstract without markup and its own label; empty if too short or a placeholder."""
    plain = strip_markup(text)
    bare = F.regexp_replace(plain, rf"(?i)^({'|'.join(ABSTRACT_LABELS)})\b[\s:.–—-]*", "")
    placeholder = F.lower(F.rtrim(bare, F.lit("."))).isin(*NO_ABSTRACT)
    return F.when((F.length(bare) >= least) & ~placeholder, F.left(bare, F.lit(most))).otherwise("")


def join_broken_lines(text: Column) -> Column:
    """Words broken at line ends put together, spaces and blank lines reduced.

    The hyphen goes where a small letter follows, but stays before "and" and "or", which belong to hanging compounds.
    """
    unix = F.replace(text, F.lit("\r"), F.lit(""))
    broken = r"(?<=\p{L})-[^\S\n]*\n[^\S\n]*"
    whole = F.regexp_replace(F.regexp_replace(unix, broken + r"(?=(?:and|or)\b)", "-"), broken + r"(?=\p{Ll})", "")
    single = F.regexp_replace(F.regexp_replace(whole, r"[^\S\n]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(single, r"\n{3,}", "\n\n"))


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(unaccented(F.trim(text)), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


# Words left out of a journal's short name.
JOURNAL_STOP_WORDS = ("the", "of", "and", "for", "in", "on", "a", "an", "to")


def initials(name: Column, most: int = 20) -> Column:
    """A journal's short name: initials of three words or more, else its words put together, each with a capital."""
    words = F.filter(F.split(unaccented(name), "[^A-Za-z0-9]+"), lambda w: (w != "") & ~F.lower(w).isin(*JOURNAL_STOP_WORDS))
    capital = lambda w: F.upper(F.left(w, F.lit(1)))
    short = F.when(F.size(words) >= 3, F.array_join(F.transform(words, capital), "")).otherwise(F.array_join(F.transform(words, lambda w: F.concat(capital(w), F.substr(w, F.lit(2)))), ""))
    return F.left(short, F.lit(most))


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet won't read as a formula."""
    return F.when(cell.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), cell)).otherwise(cell)
