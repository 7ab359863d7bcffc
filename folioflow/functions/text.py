"""Column functions over text. Patterns are plain constants, so that tests and SQL can use the same ones."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists whose exact content decides the results.
SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = r"[^\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’.\-][\p{L}\p{M}\p{N}]+|[,:]\p{N}+)*"
SENTENCE = r"[^.!?…\n]*[\p{L}\p{N}][^.!?…\n]*(?:[.!?…]+|(?=\n)|$)"
NUMBER_ONLY = r"^[\p{N},:.]+$"
ABBREVIATIONS = (
    "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Mt|vs|etc|approx|dept|No|Inc|Ltd|Co|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its me my not of on or our she so "
    "that the their them they this to was we were what when which who will with you your"
).split()
READ_WPM = 238
SPEAK_WPM = 183
RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
LOOSE_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
STRICT_EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(\.[a-zA-Z0-9-]+)+$"
CONTROL_KEPT = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
CONTROL = r"[\x00-\x1F\x7F]"
NAMED_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&rarr;", "→"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"))
FONT_RULES = (
    ("times|tinos|liberationserif|nimbusrom", "Times New Roman"),
    ("arial|helvetica|arimo|liberationsans|nimbussan", "Arial"),
    ("calibri|carlito", "Calibri"),
    ("cambria|caladea", "Cambria"),
    ("courier|cousine|mono", "Courier New"),
    ("georgia", "Georgia"),
    ("verdana", "Verdana"),
    ("garamond", "Garamond"),
    ("tahoma", "Tahoma"),
    ("segoe", "Segoe UI"),
    ("palatino|palladio", "Palatino Linotype"),
    ("bookman", "Bookman Old Style"),
    ("century", "Century Gothic"),
    ("^cm|computermodern|lmroman|nimbus|^sf[rbt]", "Times New Roman"),
)
GENERIC_FONTS = {"monospace": "Courier New", "serif": "Times New Roman"}
FORMATS = ("n", "page-n", "n-of-t", "page-n-of-t", "n-slash-t", "dash", "roman-lower", "roman-upper", "alpha", "custom")


def tokens(col: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(col, SPACE + "+"), lambda x: x != "")


def words(col: Column) -> Column:
    """Words in lower case: letters, marks and digits, joined by apostrophes, dots, hyphens or digit separators."""
    # possessive: nothing follows the group, and a word of many joins takes no stack
    return F.transform(F.regexp_extract_all(col, F.lit(WORD + "+"), F.lit(0)), F.lower)


def graphemes(col: Column) -> Column:
    """ASCII texts are counted by their length, with a return and the line end behind it as one; others by a search for clusters."""
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(ascii_only, F.length(F.replace(col, F.lit("\r\n"), F.lit("\n")))).otherwise(F.regexp_count(col, F.lit(r"\X"))).cast("long")


def without_abbreviation_dots(col: Column) -> Column:
    """Dots after titles, months and the like, and inside initials, do not end a sentence."""
    start = "(?<![A-Za-z0-9_])"
    c = F.regexp_replace(col, rf"({start}(?:{ABBREVIATIONS}))\.(?=\s+[\p{{L}}\p{{N}}])", "$1")
    c = F.regexp_replace(c, rf"(?<={start}\p{{L}}\.\p{{L}})\.(?=\s+\p{{Ll}})", "")
    return F.regexp_replace(c, rf"(?<={start}\p{{L}})\.(?=\p{{L}}\.)|(?<={start}\p{{L}})\.(?=\p{{L}}\s+\p{{Ll}})", "")


def sentence_count(col: Column) -> Column:
    found = F.regexp_extract_all(without_abbreviation_dots(col), F.lit(SENTENCE), F.lit(0))
    return F.size(F.filter(found, lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long")


def seconds_for(n_words: Column, wpm: int) -> Column:
    return F.floor(n_words / F.lit(wpm) * 60 + 0.5).cast("long")


def time_label(sec: Column) -> Column:
    m = F.floor(sec / 60)
    rest = F.pmod(sec, F.lit(60))
    return (
        F.when(sec < 60, F.concat(sec.cast("string"), F.lit(" sec")))
        .when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit(" hr "), F.pmod(m, F.lit(60)).cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(m.cast("string"), F.lit(" min")))
        .otherwise(F.concat(m.cast("string"), F.lit(" min "), rest.cast("string"), F.lit(" sec")))
    )


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def fold_presentation_forms(values: pd.Series) -> pd.Series:
    """Arabic presentation forms as the letters they stand for; other characters stay."""

    def fold(v):
        if v is None:
            return None
        return "".join(unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻿" else c for c in v)

    return values.map(fold)


def clean_text(col: Column, normalise: bool = True) -> Column:
    """Normal form C; no control characters but tab and line ends; no blanks before a line end; two line ends at most."""
    c = nfc(col) if normalise else col
    c = F.regexp_replace(c, CONTROL_KEPT, "")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_field(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, CONTROL, " "), SPACE + "+", " "))


def decode_entities(col: Column) -> Column:
    """Named, decimal and hexadecimal character references of every code point; &amp; last, so that nothing is decoded twice. A number
    that is no code point stays as it is."""
    for name, value in NAMED_ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(value))
    parts = F.split(col, "&#")

    def one(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^([xX]0*[0-9a-fA-F]{1,8}|0*[0-9]{1,8});", 1)
        base16 = number.rlike("^[xX]")
        code = F.when(base16, F.conv(F.substring(number, 2, 1 << 30), 16, 10)).otherwise(number).try_cast("long")
        known = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(63)), 8, "0")), "UTF-32")
        return F.when(known, F.concat(sign, F.substring(piece, F.length(number) + 2, 1 << 30))).otherwise(F.concat(F.lit("&#"), piece))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    joined = F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
    return F.replace(joined, F.lit("&amp;"), F.lit("&"))


def html_to_text(col: Column) -> Column:
    c = F.regexp_replace(col, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = decode_entities(F.regexp_replace(c, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def slug_name(col: Column, fallback: str = "document", most: int = 80) -> Column:
    c = F.regexp_replace(col, r"(?i)\.pdf$", "")
    c = F.regexp_replace(c, r'[\\/:*?"<>|]+', "-")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", "-"), r"-+", "-")
    c = F.regexp_replace(c, r"^-|-$", "")
    return F.substring(F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback)), 1, most)


def file_type(name: Column) -> Column:
    ext = F.upper(F.element_at(F.split(name, r"\."), -1))
    return F.when((F.length(ext) > 5) | (ext == ""), F.lit("FILE")).otherwise(ext)


def garbled(col: Column) -> Column:
    bad = F.regexp_count(col, F.lit(r"[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0B-\x1F]"))
    total = F.regexp_count(col, F.lit(r"[^ \n\t]"))
    return (total > 30) & (bad / total > 0.3)


def is_rtl(col: Column) -> Column:
    return F.regexp_count(col, F.lit(RTL)) > F.regexp_count(col, F.lit("[A-Za-z]"))


def item_is_rtl(col: Column) -> Column:
    """Whether an item has any right-to-left character."""
    return F.coalesce(col.rlike(RTL), F.lit(False))


def line_is_rtl(items: Column) -> Column:
    """Whether more than half of a line's items (an array) are right-to-left."""
    return F.size(F.filter(items, item_is_rtl)) * 2 > F.size(items)


def dehyphenate(col: Column) -> Column:
    """Words cut at a line end are joined; other line ends inside a paragraph become spaces."""
    c = F.regexp_replace(col, r"(\p{L})-\n(\p{Ll})", "$1$2")
    return F.regexp_replace(c, r"([^\n])\n([^\n])", "$1 $2")


def fix_ocr_line(col: Column, chip: bool = False) -> Column:
    """Single spaces; bullets as `•`; in chips lone brackets and bars and brackets without a partner go."""
    c = F.trim(F.regexp_replace(col, r"\s+", " "))
    if chip:
        c = F.array_join(F.filter(F.split(c, " "), lambda x: ~x.rlike(r"^[\[\](){}|]+$")), " ")
        for a, b in ("()", "[]", "{}"):
            uneven = F.regexp_count(c, F.lit("\\" + a)) != F.regexp_count(c, F.lit("\\" + b))
            c = F.when(uneven, F.translate(c, a + b, "")).otherwise(c)
    c = F.regexp_replace(c, r"^[*·▪●◦]\s*|^[-–]\s+", "• ")
    return F.regexp_replace(c, r" [·▪●◦] ", " • ")


_ONES = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
_TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
_HUNDREDS = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]
_THOUSANDS = ["", "m", "mm", "mmm"]


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999, else the decimal."""

    def digit(names: list[str], unit: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n / unit) % 10 + 1).cast("int"))

    return F.when(n.between(1, 3999), F.concat(digit(_THOUSANDS, 1000), digit(_HUNDREDS, 100), digit(_TENS, 10), digit(_ONES, 1))).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """a to z, aa and on: base 26 without a zero; other numbers as decimals."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(8)),
        F.struct(n.cast("long").alias("n"), F.lit("").alias("out")),
        lambda a, _: F.struct(
            F.when(a["n"] > 0, F.floor((a["n"] - 1) / 26)).otherwise(a["n"]).cast("long").alias("n"),
            F.when(a["n"] > 0, F.concat(F.char(F.lit(97) + (a["n"] - 1) % 26), a["out"])).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(n > 0, step).otherwise(n.cast("string"))


def page_label(n: Column, total: Column, kind: str, pad: int = 0, template: str = "{n}") -> Column:
    """A page number in one of FORMATS; digits are padded with zeros, never cut."""
    text = n.cast("string")
    num = F.when(F.length(text) < pad, F.lpad(text, pad, "0")).otherwise(text)
    tot = total.cast("string")
    custom = F.replace(F.replace(F.lit(template), F.lit("{n}"), num), F.lit("{total}"), tot)
    return {
        "n": num,
        "page-n": F.concat(F.lit("Page "), num),
        "n-of-t": F.concat(num, F.lit(" of "), tot),
        "page-n-of-t": F.concat(F.lit("Page "), num, F.lit(" of "), tot),
        "n-slash-t": F.concat(num, F.lit(" / "), tot),
        "dash": F.concat(F.lit("- "), num, F.lit(" -")),
        "roman-lower": roman(n),
        "roman-upper": F.upper(roman(n)),
        "alpha": letters(n),
        "custom": F.substring(custom, 1, 120),
    }[kind]


def valid_email(col: Column, strict: bool = False) -> Column:
    return F.coalesce(col.rlike(STRICT_EMAIL.replace("]+)+$", "]++)++$") if strict else LOOSE_EMAIL), F.lit(False))


def voter_key(salt: str, ip: Column, agent: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), ip, agent), 256), 1, 24)


def normalize_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r":\d+$", ""), r"^www\.", "")


def normalize_path(path: Column) -> Column:
    """Segments without `.` and empty ones; `..` takes the segment before away."""
    return F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)),
        lambda a: F.array_join(a, "/"),
    )


def is_bold(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "").rlike("(?i)bold|black|heavy|semibold|demi")


def is_italic(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "").rlike("(?i)italic|oblique")


def font_family(name: Column, generic: Column) -> Column:
    """Family by the first rule that matches the name without its subset prefix, else by the generic family."""
    plain = F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    out = None
    for pattern, family in FONT_RULES:
        out = F.when(plain.rlike(pattern), family) if out is None else out.when(plain.rlike(pattern), family)
    for kind, family in GENERIC_FONTS.items():
        out = out.when(generic == kind, family)
    return out.otherwise("Arial")
