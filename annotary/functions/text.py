"""Column expressions over strings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without blanks at both ends, all Unicode blanks included (``trim`` knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def year_of(date: Column) -> Column:
    """The text before the first ``-`` as an integer; null where it is none."""
    return F.split(date, "-")[0].try_cast("int")


def eligible(languages: Column, pubdate: Column, after: int = 1980, language: str = "eng") -> Column:
    """Exactly one language and a year strictly after ``after``; a null or unreadable year is -1."""
    return F.coalesce(languages.eqNullSafe(language), F.lit(False)) & (F.coalesce(pubdate.cast("string").try_cast("int"), F.lit(-1)) > after)


def tiab(title: Column, abstract: Column) -> Column:
    """Title and abstract with a blank between, stripped; null counts as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def stem(path: Column, extensions: int = 2) -> Column:
    """The file's name without its last ``extensions`` extensions."""
    s = basename(path)
    for _ in range(extensions):
        s = F.regexp_replace(s, r"(?s)(?<=.)\.[^.]*$", "")
    return s


def words(text: Column) -> Column:
    """Different words of a text: longest runs of letters or digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def containment(text: Column, label: Column) -> Column:
    """Share of the label's different words that the text holds; 0 for a label without words."""
    n = F.size(words(label))
    return F.when(n > 0, F.size(F.array_intersect(words(text), words(label))) / n).otherwise(F.lit(0.0))


def last_answer(text: Column) -> Column:
    """What follows the last ``ANSWER:``, stripped; null without a marker, empty where nothing follows."""
    # (?d): only line feeds end a line
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?d)(?U)ANSWER:\s*(.*)"), F.lit(1))
    return strip(F.try_element_at(found, F.lit(-1)))


def clean_token(c: Column) -> Column:
    """Stripped of blanks, then of any run of quotes at both ends; blanks inside the quotes stay."""
    return F.regexp_replace(strip(c), r"""^['"]+|['"]+$""", "")


def id_tokens(packed: Column) -> Column:
    """The cleaned non-empty tokens of a ``;`` list, in order; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(packed, F.lit("")), ";", -1), clean_token), lambda x: x != "")


def parse_ids(packed: Column) -> Column:
    """Stripped non-blank tokens of a ``;`` list; none for null or blank."""
    return F.filter(F.transform(F.split(F.coalesce(packed, F.lit("")), ";", -1), strip), lambda x: x != "")


def first_number(packed: Column) -> Column:
    """First token of a ``;`` list as a whole number; ``12.0`` is 12, anything else null."""
    d = strip(F.split(packed, ";")[0]).try_cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 9e15), d.cast("bigint"))


def candidate_lines(labels: Column) -> Column:
    """``1) a`` and so on, a line each."""
    return F.concat_ws("\n", F.transform(labels, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)))


#: Our own wording; a caller passes its own template around text and candidate lines.
PROMPT = (
    "Read the article and choose the entries that it reports on.\n\nARTICLE:\n",
    "\n\nCANDIDATES:\n",
    "\n\nEnd with one line: ANSWER: followed by the chosen identifiers separated by ';', or NO MATCH.\n",
)


def prompt(text: Column, labels: Column, template: tuple[str, str, str] = PROMPT) -> Column:
    a, b, c = map(F.lit, template)
    return F.concat(a, F.coalesce(text, F.lit("")), b, candidate_lines(labels), c)


def max_score(candidates: Column) -> Column:
    """The greatest score of a candidate list; null for none, NaN left out."""
    return F.array_max(F.filter(F.transform(candidates, lambda x: x["score"]), lambda s: ~F.isnan(s)))


def subset(a: Column, b: Column) -> Column:
    """Whether non-empty ``a`` is within ``b``; a null list is empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
