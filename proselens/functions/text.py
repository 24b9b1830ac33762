"""Column expressions over text. All are built-in functions, so they stay in the JVM and can be pushed into any plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once; as a lambda it also keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The characters that have the White_Space property.
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """No white space at the ends. Trimming looks at the ends alone, so that long runs of blanks inside cost nothing."""
    return F.btrim(c, F.lit(_BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sentences(c: Column, mode: str = "intended") -> Column:
    """Sentences of a text. mode 'literal' keeps the whole text as one, as a splitter whose pattern never matches does."""
    if mode == "literal":
        return F.filter(F.array(strip(c)), lambda s: s != "")
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(C.WORD), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def syllables(c: Column) -> Column:
    """Vowel groups outside of links, addresses and numbers; at least 1 for a text, 0 for an empty one."""
    return F.when(c == "", 0).otherwise(F.greatest(F.lit(1), count(F.regexp_replace(c, C.NOT_SPOKEN, " "), C.VOWELS)))


def complex_words(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: count(w, C.VOWELS) >= 3))


def part_of_speech(w: Column) -> Column:
    """Word lists first, then endings; everything else is a noun."""
    out = F.when(w.isin(C.PRONOUNS), "PRON").when(w.isin(C.DETERMINERS), "DET").when(w.isin(C.CONJUNCTIONS), "CCONJ").when(w.isin(C.ADPOSITIONS), "ADP")
    out = out.when(w.endswith("ly"), "ADV").when(w.endswith("ed") | w.endswith("ing"), "VERB")
    return out.when(reduce(Column.__or__, [w.endswith(x) for x in C.ADJECTIVE_ENDS]), "ADJ").otherwise("NOUN")


def page_text(c: Column) -> Column:
    """A page as extracted: no carriage returns, words joined over line ends, few blank lines, plain blanks."""
    c = F.regexp_replace(c, "\r", "")
    c = F.regexp_replace(c, r"(?U)(?<=\w)-\s*\n(?=\w)", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[\t\u00A0]+", " ")


#: What opens and closes formulas that end otherwise than they begin, and noncharacters that stand for openers meanwhile.
_FORMULAS = (("\\(", "\\)", "\ufdd0"), ("\\[", "\\]", "\ufdd1"), ("\\begin{equation}", "\\end{equation}", "\ufdd2"))


def _aside(opener: str, closer: str, mark: str):
    def of(x: Column) -> Column:
        rest = F.substring_index(x, closer, -1)
        return F.concat(F.left(x, F.length(x) - F.length(rest)), F.replace(rest, F.lit(opener), F.lit(mark)))

    return of


def strip_math(c: Column) -> Column:
    """Formulas as one space. Openers behind the last closer of their kind open nothing; they are put aside, as each would
    look for its end through the rest of the text."""
    held = c
    for opener, closer, mark in _FORMULAS:
        held = F.when(held.contains(opener), let(held, _aside(opener, closer, mark))).otherwise(held)
    out = F.regexp_replace(held, C.MATH, " ")
    for opener, _, mark in _FORMULAS:
        out = F.replace(out, F.lit(mark), F.lit(opener))
    return F.when(c.rlike(r"[$\\]"), out).otherwise(c)


def clean_sentence(c: Column) -> Column:
    return squeeze(strip_math(c))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def label(c: Column) -> Column:
    """A label in lower case, synonyms resolved."""
    x = F.lower(F.trim(c))
    known = F.create_map(*(F.lit(v) for pair in C.LABEL_SYNONYMS.items() for v in pair))
    return F.coalesce(F.element_at(known, x), x)


def plain_label(x: str) -> str:
    """label() of a name in Python, for a classifier's own label names."""
    x = x.lower().strip()
    return C.LABEL_SYNONYMS.get(x, x)


# --- headings


def normal_heading(c: Column) -> Column:
    """Lower-case words without stop words, numbers and Roman numerals."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"[\\-_]+", " "), "[^A-Za-z0-9 ]+", " ")), " +", " ")), " ")
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(list(C.HEADING_STOP_WORDS)) & ~t.rlike("^[0-9]+$") & ~t.rlike("^[ivxlcdm]+$")), " ")


def normal_form(heading: str) -> str:
    import re

    words = re.sub("[^A-Za-z0-9 ]+", " ", heading.replace("-", " ")).lower().split()
    return " ".join(w for w in words if w not in C.HEADING_STOP_WORDS and not w.isdigit() and not re.fullmatch("[ivxlcdm]+", w))


def _near(x: Column, headings) -> Column:
    """A similarity of 0.97 of matching characters is equality, or one added or missing character in texts of 17 and more."""
    like = lambda h: (F.abs(F.length(x) - F.length(h)) == 1) & (F.least(F.length(x), F.length(h)) >= 17) & (F.levenshtein(x, h) == 1)
    return F.exists(F.array(*(F.lit(h) for h in headings)), like)


#: At most four words that a normal form keeps, however many stop words, numbers and Roman numerals there are: no known
#: heading, and nothing one character away from one, has more. Long texts fail at their fifth such word.
_FEW_WORDS = r"(?i)^[^a-z0-9]*+(?:(?:%(drop)s)(?:[^a-z0-9]++|$))*+(?:[a-z0-9]++(?:[^a-z0-9]++|$)(?:(?:%(drop)s)(?:[^a-z0-9]++|$))*+){0,4}+$" % {"drop": "|".join((*C.HEADING_STOP_WORDS, "[0-9]++", "[ivxlcdm]++"))}
_FORMS = tuple(dict.fromkeys(normal_form(h) for h in C.KNOWN_HEADINGS))
_LONG = tuple(h for h in C.KNOWN_HEADINGS if len(h) >= 16)
_LONG_FORMS = tuple(dict.fromkeys((*_LONG, *(f for f in _FORMS if len(f) >= 16))))


def known_heading(c: Column) -> Column:
    raw = lambda x: F.when(F.length(x) <= 32, x.isin(list(C.KNOWN_HEADINGS)) | ((F.length(x) >= 16) & _near(x, _LONG))).otherwise(False)
    form = lambda x: x.isin(list(_FORMS)) | (F.length(x).between(16, 32) & _near(x, _LONG_FORMS))

    def judge(x: Column) -> Column:
        return (x != "") & (let(F.lower(x), raw) | F.when(x.rlike(_FEW_WORDS), let(normal_heading(x), form)).otherwise(False))

    return F.coalesce(let(strip(c), judge), F.lit(False))


def short_heading(c: Column) -> Column:
    x = squeeze(F.split(strip(c), ":")[0])
    return (c != "") & (F.length(x) <= C.MAX_HEADING_CHARS) & (F.size(F.filter(F.split(x, " "), lambda w: w != "")) <= C.MAX_HEADING_WORDS)


def known_with_prefix(c: Column) -> Column:
    """A known heading as it stands, before a colon, or after a leading whole number or Roman numeral."""
    forms = F.array_compact(F.array(strip(c), F.when(c.contains(":"), F.split(strip(c), ":")[0]), F.when(strip(c).rlike(_NUMBERED), F.regexp_replace(strip(c), _NUMBERED, ""))))
    return F.coalesce(F.exists(forms, known_heading), F.lit(False))


_NUMBERED = r"^(?:[0-9]+\.*|[IVXLCMivxlcm]+\.?)\s+"


def looks_like_heading(line: Column) -> Column:
    """Short, and known, mostly in capitals, begun by a number or a Roman numeral with a full stop, or ended by a colon;
    or short and known before a colon."""

    def judge(x: Column) -> Column:
        letters, capitals = count(x, r"\p{L}"), count(x, r"\p{Lu}")
        many = (letters > 0) & (capitals >= letters * 0.6)
        numbered = x.rlike(r"^(?:\d|[IVXLCM]+\.)")
        colon = x.endswith(":") & (F.size(F.split(x, r"\s+")) <= 12)
        before = F.split(x, ":")[0]
        return F.when(short_heading(x), many | numbered | colon | known_heading(x)).otherwise(False) | F.when(x.contains(":") & short_heading(before), known_heading(before)).otherwise(False)

    return F.coalesce(let(strip(line), lambda x: F.when(x == "", False).otherwise(judge(x))), F.lit(False))


def style_heading(text: Column, size: Column, flags: Column, base: Column) -> Column:
    """A heading by type size, weight, number or name, in a laid-out line."""
    x = strip(text)
    fits = (x != "") & (F.length(x) <= C.MAX_HEADING_CHARS) & (F.size(F.split(x, r"\s+")) <= C.MAX_HEADING_WORDS) & ~x.endswith(".")
    bigger = (base > 0) & (size >= base * 1.18)
    bold = (base > 0) & (flags.bitwiseAND(2) != 0) & (size >= base * 1.06)
    return fits & (bigger | bold | x.rlike(r"^(?:[0-9]+(?:\.[0-9]+)*|[IVXLCM]+[.])\s+") | known_heading(x))


def _first_fit(x: Column, names: dict) -> Column:
    """The name of the first synonym that x equals or begins with as a word, or null."""
    pairs = F.array(*(F.struct(F.lit(syn).alias("s"), F.lit(name).alias("n")) for name, syns in names.items() for syn in syns))
    return F.get(F.filter(pairs, lambda p: (x == p["s"]) | F.startswith(x, F.concat(p["s"], F.lit(" ")))), F.lit(0))["n"]


def canonical_section(title: Column) -> Column:
    """The canonical section whose alias the title equals or begins with; the title in capitals if there is none."""
    flat = F.trim(F.regexp_replace(F.upper(F.regexp_replace(title, r"[^A-Za-z0-9 ]+", " ")), " +", " "))
    return let(flat, lambda x: F.when(x == "", "SECTION").otherwise(F.coalesce(_first_fit(x, C.SECTION_ALIASES), x)))


def layout_heading(c: Column) -> Column:
    return squeeze(F.regexp_replace(squeeze(c), C.HEADING_NUMBER, ""))


def ontology(c: Column) -> Column:
    """The label whose synonym the heading equals or begins with, else its own name, else null."""
    flat = squeeze(F.regexp_replace(F.lower(layout_heading(c)), r"(?U)[^\w\s]", ""))
    return let(flat, lambda x: F.coalesce(_first_fit(x, C.ONTOLOGY), F.when(x.isin([k.lower() for k in C.ONTOLOGY]), F.upper(x))))


def layout_heading_guess(text: Column, size: Column, bold: Column, median: Column) -> Column:
    x = strip(text)
    fits = (F.length(x) <= 120) & (F.size(F.split(x, r"\s+")) <= 14) & ~x.endswith(".")
    return fits & ((size >= median + 1.5) | bold | x.rlike(C.HEADING_NUMBER))


def keywords(text: Column) -> Column:
    """Keywords of a keyword section's text."""
    rest = squeeze(F.regexp_replace(text, r"(?i)^\s*keywords?\s*[:\-–—]?\s*", ""))
    return F.filter(F.transform(F.split(rest, "[;,]"), lambda k: F.regexp_replace(k, r"^[ .;:]+|[ .;:]+$", "")), lambda k: k != "")


# --- matching of texts in laid-out pages


def run_of(words: Column, target: Column) -> Column:
    """The place, from 0, where target's words first stand one after another among words, in lower case; null if nowhere."""
    low = lambda a: F.transform(a, F.lower)
    last = F.size(words) - F.size(target)
    hits = lambda w, t: F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(w, i + 1, F.size(t)) == t)
    return F.when((F.size(target) > 0) & (last >= 0), let(low(words), lambda w: let(low(target), lambda t: F.get(hits(w, t), F.lit(0)))))


def contains_text(block: Column, text: Column) -> Column:
    """Whether a block holds a text, white space and case aside."""
    t = F.lower(squeeze(text))
    return F.coalesce((t != "") & F.lower(squeeze(block)).contains(t), F.lit(False))


def snippets(text: Column, clean: Column) -> Column:
    """What to look for on a page, in order: each form of a text whole, without the blanks beside its hyphens, and its
    first eight to three words; what repeats, case aside, is left out."""

    def of(base: Column) -> Column:
        words = F.split(base, " ")
        n = F.size(words)
        least = F.when(n > 3, 3).otherwise(n)
        heads = F.transform(F.reverse(F.sequence(least, F.least(n, F.lit(8)))), lambda k: F.array_join(F.slice(words, 1, k), " "))
        return F.when(base == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(base, F.replace(base, F.lit("- "), F.lit("-")), F.replace(base, F.lit(" -"), F.lit("-"))), heads))

    both = F.concat(let(squeeze(F.coalesce(text, F.lit(""))), of), let(squeeze(F.coalesce(clean, F.lit(""))), of))
    return let(both, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, F.lower), F.lower(x)) == i + 1))


def to_double(c: Column) -> Column:
    """A number, or null where the text isn't one."""
    return c.try_cast("double")
