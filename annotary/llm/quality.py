"""Text statistics of each document, and its nearest structural profile.

A document is described by four distributions over its words and characters:

* character classes (lower, upper, digit, blank, line break, kinds of punctuation, other);
* kinds of words: function words of each of four languages, other words by how they are
  written (lower, capitalised, upper, digits, letters with digits, symbols);
* how long the units are that its words stand in. A unit ends at a sentence's end, and at a
  line's end unless the text runs on (hard-wrapped prose);
* novelty: words in units that stand there for the first time, and in repeated ones.

The same is computed for a short specimen of each structure: prose in four languages, and
lists, tables, markup, sequences and so on. The distance to a profile is the sum of the four
Jensen-Shannon divergences; the nearest profile gives the document's structure. Each prose
profile stands there a second time with its first sentence repeated. Prose mostly in letters
other than Latin ones is compared with prose whose function words are not known. Upper-case
prose is compared in lower case.

Prose specimens are passages of the Universal Declaration of Human Rights and a paragraph
written for this module; the function words are the usual short lists of each language's
articles, prepositions, pronouns, conjunctions and auxiliaries; the other specimens are about
gardens, ships and shops. None is taken from a table that the module is applied to.

The basic counts are expressions and stay in the JVM; only the profiles need Python.

Documents with several parts (a text and a table below it) are described as a whole, so the
larger part decides.

Defined cases: null and empty texts, and those of blanks only, have structure ``empty``,
counts 0 and no distances; they are not cases of non-prose. Texts are read whole. Repeated
rows get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotary.runtime import spread

#: Articles, prepositions, conjunctions, pronouns, auxiliaries and a few adverbs of each language.
FUNCTION_WORDS = {
    "en": "the a an of in on at to from by with for into about over under after before between through during without within and or but nor so yet if because while "
    "although though than that this these those which who whom whose what when where why how i you he she it we they me him her us them my your his its our their "
    "is are was were be been being am has have had do does did will would shall should can could may might must not no all any some such each both more most other only also there as",
    "fr": "le la les l un une des du de d à au aux en dans par pour sur sous avec sans entre vers chez depuis pendant après avant contre et ou mais ni donc car si que qu qui quoi dont où "
    "comme lorsque quand je tu il elle on nous vous ils elles me te se s lui leur leurs son sa ses mon ma mes ton ta tes notre nos votre vos ce c cet cette ces cela est sont était "
    "étaient être été a ont avait avaient avoir fait peut plus moins très ne n pas aucun aucune tout toute tous toutes même aussi y",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber denn sondern doch wenn weil dass ob als wie zu zum zur in im an am auf aus bei beim mit nach seit von vom vor für "
    "durch gegen ohne um über unter zwischen bis ich du er sie es wir ihr mich dich sich uns euch ihn ihm ihnen mein dein sein seine seiner ihre ihrer unser dieser diese dieses jeder jede jedes "
    "welche ist sind war waren wird werden wurde wurden worden hat haben hatte hatten kann können soll sollen muss darf nicht kein keine keiner keinem keinen auch nur noch schon sehr mehr so da",
    "es": "el la los las un una unos unas de del a al en con por para sin sobre entre desde hasta hacia contra durante tras y e o u pero ni sino si porque aunque como cuando donde que quien cual "
    "cuyo yo tú él ella nosotros ellos ellas me te se nos le les lo su sus mi mis tu tus nuestro este esta estos estas ese esa eso aquel es son era eran ser sido fue fueron está están ha han "
    "había haber hay tiene puede no más menos muy también ya todo toda todos todas otro otra",
}
_LANGUAGES = list(FUNCTION_WORDS)
#: The languages of each function word; one of several languages counts in parts.
_KNOWN = {w: [i for i, k in enumerate(_LANGUAGES) if w in FUNCTION_WORDS[k].split()] for v in FUNCTION_WORDS.values() for w in v.split()}
_KINDS = ["lower", "capital", "upper", "digits", "mixed", "symbols", "joined"]
#: Characters of each class; of the rest, letters of any script are lower or upper, blanks blank, and others ``other``.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \xa0\u3000", "\n\r", ".!?。！？؟।۔", ",;:、，；：،؛", "'\"’“”()-–—「」（）", "<>{}=[]", "|\t"]
_OTHER = len(_CLASSES)
#: Last number of words in each class of unit lengths.
_LENGTHS = [1, 3, 6, 10]
_SENTENCE = re.compile(r"(?<=[.!?؟।۔])[\"'”’)\]]*\s+(?=\S)")
_ITEM = re.compile(r"[,;|]\s+|\s+[|>]\s+")
#: Words that lose a vowel before the next one.
_ELIDED = re.compile(r"\b([cdjlmnst]|qu)['’](?=\w)", re.IGNORECASE)
#: Scripts written without blanks: a word is counted for each two of their characters.
_CLOSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]+")
_WIDE_STOPS = str.maketrans({"。": ". ", "！": "! ", "？": "? ", "、": ", ", "，": ", ", "；": "; ", "：": ": "})
WEIGHTS = (1.0, 1.0, 1.0, 1.0)


@cache
def _class_of() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.int8)
    for i in range(0x80, 0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = 1 if i < 0x2000 and c.isupper() and not 0xC0 <= i < 0x250 else 0
    for i, chars in enumerate(_CLASSES):
        for c in chars:
            table[ord(c)] = i
    return table


#: Passages of the Universal Declaration of Human Rights (a fixed text).
_RIGHTS = {
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit \
of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be \
prohibited in all their forms. No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment. Everyone has the right to leave any \
country, including his own, and to return to his country. Men and women of full age, without any limitation due to race, nationality or religion, have the right to marry \
and to found a family. The family is the natural and fundamental group unit of society and is entitled to protection by society and the State.""",
    "fr": """Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres \
dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la \
traite des esclaves sont interdits sous toutes leurs formes. Nul ne sera soumis à la torture, ni à des peines ou traitements cruels. Toute personne a le droit de quitter \
tout pays, y compris le sien, et de revenir dans son pays. La famille est l'élément naturel de la société et a droit à la protection de l'État.""",
    "de": """Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit \
begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel \
in allen ihren Formen sind verboten. Niemand darf der Folter oder grausamer Behandlung unterworfen werden. Jeder hat das Recht, jedes Land, einschließlich seines eigenen, \
zu verlassen und in sein Land zurückzukehren. Die Familie ist die natürliche Grundeinheit der Gesellschaft und hat Anspruch auf Schutz durch Gesellschaft und Staat.""",
    "es": """Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con \
los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la \
trata de esclavos están prohibidas en todas sus formas. Nadie será sometido a torturas ni a tratos crueles. Toda persona tiene derecho a salir de cualquier país, incluso \
el propio, y a regresar a su país. La familia es el elemento natural de la sociedad y tiene derecho a la protección de la sociedad y del Estado.""",
}
#: Prose of a trade: more names, numbers and terms, fewer function words.
_TRADE = """Granite blocks from the northern quarry arrived by barge in April. Because frost loosens mortar, masons may replace coping stones along Pier 12 within \
weeks (see Table 3). Steel girders carried heavy cranes, while timber sheds sheltered rope, tar and sailcloth. Tidal gauges recorded 4.2 m at Westgate and 3.9 m at LNB2. \
Harbour pilots rejected larger tugs after brief trials. Later surveys found rusted bolts in 17 of 60 frames, and divers sealed cracked valves near Dock GR7 before winter. \
Paint samples with lead content above 0.5 % were scraped from hulls, funnels and rails."""
SPECIMENS = {
    **{f"prose_{k}": v for k, v in _RIGHTS.items()},
    "prose_trade": _TRADE,
    "list_marked": "\n".join(["- small baskets of the market;", "- heavy lanterns;", "- woven blankets of the north;", "- late tulips;", "* garden shears", "* wooden ladders of the orchard", "• broken flowerpots", "• copper kettles of the kitchen"]),
    "list_plain": "\n".join(["small baskets of the market", "heavy lanterns", "woven blankets of the north", "late tulips", "garden shears of the orchard", "wooden ladders"]),
    "list_stopped": "\n".join(["small baskets of the market.", "heavy lanterns.", "woven blankets of the north.", "late tulips.", "garden shears of the orchard.", "wooden ladders."]),
    "list_names": "KLM2B\nTUB3\nQRST\nVAN17\nWXZ4A\nHIJK\nBCDA\nFGHE5",
    "list_line": "lanterns; KLM2B; blankets; TUB3; kettles; QRST4; flowerpots; ladders; VAN17; tulips",
    "list_piped": "lanterns | KLM2B | blankets | TUB3 | kettles | QRST4 | flowerpots | ladders | VAN17 | tulips",
    "references": "\n".join(
        [
            "1. Potter J, Cook K. Lanterns and ladders in the harbours of Norway. Ann Ships Harbours. 1971;31:349-721.",
            "2. Mason T, Fisher R. Role of tar in ropes of the navy. J Timber Sailcloth. 1968;12:85-92.",
            "3. Tanner A, Weaver E. A heavy kettle in the kitchens of a northern monastery. Acta Gardens. 1985;7:101-119.",
        ]
    ),
    "table_piped": "blankets | early spring | in the north | yes\nlanterns lit | half price | in the yard | no |\nkettles | late autumn | in the kitchen | not sold.\ntulips | mixed colours | in the frame | yes",
    "table_tabbed": "blankets\tearly spring\tin the north\tyes\nlanterns lit\thalf price\tin the yard\tno.\nkettles\tlate autumn\tin the kitchen\tnot sold\ntulips\tmixed colours\tin the frame\tyes",
    "table_numbers": "ship | dock | crew | depth | m\nKLM2B | 31 | 45 | 0.146 | 0.0003\nTUB3 | 5 | 251 | 0.017 | 0.0412\nQRST | 40 | 300 | 0.956 | 0.7709",
    "table_tabs": "ship\tdock\tcrew\tdepth\tm\nKLM2B\t31\t45\t0.146\t0.0003\nTUB3\t5\t251\t0.017\t0.0412\nQRST\t40\t300\t0.956\t0.7709",
    "table_commas": "ship,dock,crew,depth,m\nKLM2B,31,45,0.146,0.0003\nTUB3,5,251,0.017,0.0412\nQRST,40,300,0.956,0.7709",
    "table_spaced": "ship   dock   crew   depth   m\nKLM2B   31   45   0.146   0.0003\nTUB3   5   251   0.017   0.0412\nQRST   40   300   0.956   0.7709",
    "contents": "Lantern workshop ........ 12\nBlankets and rugs ............ 118\nKettles follow-up ................ 231\nTulip beds ... 304",
    "markup": '<row id="51"><name>lantern</name><n>12</n></row>\n<item id="87"><name>blanket</name><n>31</n></item>\n<sec id="9"><name>kettle</name><n>4</n></sec>',
    # four letters drawn at random, two rows under a heading; codes of changes; random bytes in base64
    "sequence": ">row_12 KLM2B\nCATGGTCAACGTGATTACGCCTAAGTGCATCCGATAGTTCAGCAATGCCGTATGACCTGAT\nGGCATTACGATCCGTTAACGGATCATGCCATAGTCGATTCAGGCTAACTGCATCGGATCA",
    "variants": "KLM2B:c.4715A>G (p.Ser553Trp)\nTUB3:c.1132C>T (p.Gly103Ter)\nQRST:c.77G>A (p.Arg26fs)\nVAN17:c.3979T>C (p.Leu749Asp)",
    "encoded": "q83vEjRWeJCrze8SNFZ4kKvN7xI0VniQq83vEjRWeJC7Rk1aT2pQd0xZbHg5K0ZtVHdKc1ZyZU5i\nVGhLbm9QeFl6UUxjRGZHaUprTW5PcFFyU3RVdld4WXphQmNEZUZnSGlKa0xtTm9QcVJzVHVWd1h5",
    "navigation": "About us | Stores | Gift cards (2) | My account | Newsletter | Careers | Returns | Sitemap | Opening hours | Terms of use | Wish list | Top of page | Language",
    "navigation_path": "About us > Stores > Gift cards (2) > My account > Newsletter > Careers > Returns > Sitemap > Opening hours > Terms of use > Wish list > Top of page > Language",
    "navigation_lines": "About us\nStores\nGift cards (2)\nMy account\nNewsletter\nCareers\nReturns\nSitemap\nOpening hours\nTerms of use\nWish list\nTop of page\nLanguage",
    "salad": " ".join(FUNCTION_WORDS["en"].split()[:30] * 3),
    "garbled": re.sub(r"[aeinot]", lambda m: "âÃ©¿ï€"["aeinot".index(m.group())], _RIGHTS["en"]),
}
#: Each prose specimen's first sentence again and again.
SPECIMENS |= {f"repeated_{k[6:]}": (re.split(r"(?<=\.) ", v)[0] + "\n") * 20 for k, v in SPECIMENS.items() if k.startswith("prose_")}


def units(text: str) -> list[str]:
    """Sentences, list items or rows. Lines are joined where the text is hard-wrapped: most lines that do not end a
    sentence are about as long as the longest near them, and sentences end within lines or function words at their ends. A line that is a
    row of items gives its items."""
    lines = [x.strip() for x in text.split("\n")]
    if not any(lines):
        return []
    sizes = [len(x) for x in lines]
    wide = [max(sizes[max(0, i - 3) : i + 4]) for i in range(len(lines))]
    open_ = [i for i, (x, y) in enumerate(zip(lines, lines[1:])) if x and y and x[-1] not in ".!?;:"]
    wrapped = False
    if open_ and " " in text and "\t" not in text and " | " not in text:
        even = sum(sizes[i] >= 0.6 * wide[i] for i in open_)
        joints = sum(lines[i].rsplit(" ", 1)[-1].lower() in _KNOWN or lines[i + 1].split(" ", 1)[0].lower() in _KNOWN for i in open_)
        inside = any(". " in x or "? " in x for x in lines)
        wrapped = even >= 0.75 * len(open_) and (inside or joints >= 0.12 * len(open_)) and max(wide) >= 25
    out: list[str] = []
    cur: list[str] = []
    for x, y, near in zip(lines, [*lines[1:], ""], wide):
        if x:
            cur.append(x)
        if cur and not (wrapped and x and y and len(x) >= 0.6 * near and " " in x):
            out.append(" ".join(cur))
            cur = []
    found = [s for u in out for s in _SENTENCE.split(u) if s]
    rows = []
    for u in found:
        items = _ITEM.split(u)
        barred = u.count(" | ") + u.count(" > ") > 3
        rows += items if len(items) > 3 and (barred or len(items) > 0.35 * (u.count(" ") + 1)) else [u]
    return rows


@lru_cache(200_000)
def _word(w: str) -> tuple[int, ...]:
    """Classes of a word: its languages if it is a function word, else how it is written."""
    core = w.strip(".,;:!?()[]\"'“”’•*")
    known = _KNOWN.get(core.lower())
    if known:
        return tuple(known)
    if not core:
        kind = "symbols"
    elif re.fullmatch(r"[\d.,%<>=±/:-]+", core):
        kind = "digits"
    elif core.isalpha():
        kind = "lower" if core.islower() or core.lower() == core.upper() else "upper" if core.isupper() else "capital" if core[1:].islower() else "mixed"
    elif all(x.isalpha() for x in re.split(r"[-'’–]", core) if x):
        kind = "joined"
    else:
        kind = "mixed" if core.isalnum() and len(core) < 20 else "symbols"
    return (len(_LANGUAGES) + _KINDS.index(kind),)


_SIZES = (_OTHER + 1, len(_LANGUAGES) + len(_KINDS), len(_LENGTHS) + 1, 2)


def describe(text: str) -> tuple[list[np.ndarray], dict[str, float], bool]:
    """The four distributions of a text, the words of a unit and the share of repeated words, and whether its letters are mostly not Latin."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars = np.bincount(_class_of()[codes], minlength=_SIZES[0]).astype(float)
    upper, letters = chars[1], chars[0] + chars[1]
    beyond = codes[codes >= 0x250]
    foreign = len(beyond) > 0 and bool((_class_of()[beyond] <= 1).sum() > 0.5 * letters)
    if foreign and _CLOSE.search(text):
        text = _CLOSE.sub(lambda m: " ".join(m.group()[i : i + 2] for i in range(0, len(m.group()), 2)), text.translate(_WIDE_STOPS))
        chars[3] += text.count(" ")  # as if it were written with blanks
    if upper > 0.8 * letters > 0.45 * len(codes) and text.count(" ") > 0.08 * len(codes):
        text = text.lower()
        chars[:2] = letters, 0
    found = units(text)
    lengths = np.zeros(_SIZES[2])
    for u in found:
        n = u.count(" ") + 1
        lengths[bisect_left(_LENGTHS, n)] += n
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    # words in units, or in whole lines, that stood there before
    again = max(sum(len(u.split()) * (n - 1) for u, n in Counter(k.strip(" .;|-*•") for k in some).items()) for some in (found, lines))
    kinds = np.zeros(_SIZES[1])
    ws = _ELIDED.sub(r"\1 ", text).split()
    for w, n in Counter(ws).items():
        at = _word(w) if len(w) < 40 else (len(_LANGUAGES) + _KINDS.index("symbols"),)
        for i in at:
            kinds[i] += n / len(at)
    share = min(1.0, again / len(ws))
    again = share**1.25  # a text that stands there twice is not yet nearer to repetition
    return [chars, kinds, lengths, np.array([1 - again, again]) + 0.1], {"mean_unit": len(ws) / max(1, len(found)), "repeated_share": share}, foreign


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences in bits of the rows of ``p`` and the one distribution ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
    q = q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return (a + b) / 2


@cache
def profiles() -> dict[str, list[np.ndarray]]:
    """The specimens' distributions, and ``prose_other``: prose whose function words are not known."""
    out = {name: describe(text)[0] for name, text in sorted(SPECIMENS.items())}
    chars, kinds, lengths, novelty = out["prose_en"]
    other = kinds.copy()
    other[len(_LANGUAGES)] += other[: len(_LANGUAGES)].sum()
    other[: len(_LANGUAGES)] = 0
    return out | {"prose_other": [chars, other, lengths, novelty], "repeated_other": [chars, other, lengths, out["repeated_en"][3]]}


_STRUCTURE = ["mean_unit", "repeated_share", "structure", "distance", "prose_distance", "is_prose"]


def judge(texts: Sequence[str | None]) -> pd.DataFrame:
    """Of each text the nearest structure and its distance, the distance to the nearest prose profile, and what the units are like."""
    blank = {"mean_unit": 0.0, "repeated_share": 0.0, "structure": "empty", "distance": None, "prose_distance": None, "is_prose": None}
    rows: list[dict] = [dict(blank) for _ in texts]
    full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
    if full:
        own = [describe(texts[i]) for i in full]
        parts = [np.stack([o[0][k] for o in own]) for k in range(len(_SIZES))]
        names = list(profiles())
        d = np.stack([sum(w * divergence(p, q) for w, p, q in zip(WEIGHTS, parts, profiles()[n])) for n in names], axis=1)
        # prose without known function words is no measure for Latin letters
        d[np.ix_([not o[2] for o in own], [n.endswith("_other") for n in names])] = np.inf
        prose = np.array([n.startswith("prose_") for n in names])
        for j, i in enumerate(full):
            k = int(d[j].argmin())
            name = "prose" if prose[k] else "repeated" if names[k].startswith("repeated_") else names[k]
            rows[i] = own[j][1] | {"structure": name, "distance": float(d[j, k]), "prose_distance": float(d[j, prose].min()), "is_prose": name == "prose"}
    return pd.DataFrame(rows, columns=_STRUCTURE)


#: Blanks as both Java and SQL engines know them.
_BLANK = r" \t\n\x0B\f\r"


def basic_counts(text: Column) -> dict[str, Column]:
    """The basic counts as expressions; 0 where there is nothing to count."""
    text = F.coalesce(text, F.lit(""))
    found = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    words, lines = found(f"[^{_BLANK}]+"), found(rf"[^\n]*[^{_BLANK}][^\n]*")
    letters = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    common = F.size(F.filter(letters, lambda w: w.isin(sorted(_KNOWN))))
    return {
        "n_words": words.cast("long"),
        "mean_word_length": share(F.length(F.regexp_replace(text, f"[{_BLANK}]+", "")), words),
        "symbol_ratio": share(F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{_BLANK}]+", "")), F.length(text)),
        "punctuated_lines": share(found(r"""[.!?"'”’)][ \t\x0B\f\r]*(?:\n|\z)"""), lines),
        "common_words": share(common, F.size(letters)),
    }


_TYPES = "mean_unit double, repeated_share double, structure string, distance double, prose_distance double, is_prose boolean"


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), judge(list(pdf["text"]))], axis=1)


def structures(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(id, text)``: structure, distances, ``is_prose``."""
    return spread(docs.select("id", "text")).mapInPandas(_judged, f"id long, {_TYPES}")


def counts(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(id, text)``: the basic counts."""
    return docs.select("id", *[c.alias(n) for n, c in basic_counts(F.col("text")).items()])


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(id, text)``: basic counts, structure, distances, ``is_prose``; texts are read once."""
    counted = spread(docs.select("id", "text")).select("id", "text", *[c.alias(n) for n, c in basic_counts(F.col("text")).items()])
    types = "n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double"
    return counted.mapInPandas(_judged, f"id long, {types}, {_TYPES}")
