"""Text functions: markdown, titles, citations' dates, keyboard layouts, embedding input."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketry.functions.frontmatter import lines, strip_frontmatter, trimmed


def strip_markdown_line(line: Column) -> Column:
    """A line without heading marks, bold marks and outer white space."""
    t = trimmed(line)
    return F.regexp_replace(F.when(t.startswith("#"), trimmed(F.regexp_replace(t, "^#+", ""))).otherwise(t), r"\*\*", "")


def plain(rows: Column) -> Column:
    """An array of lines as plain text: stripped lines that aren't empty."""
    return F.array_join(F.filter(F.transform(rows, strip_markdown_line), lambda x: x != ""), "\n")


def full_text(raw: Column) -> Column:
    """A document without its header and markup."""
    return plain(lines(strip_frontmatter(raw)))


def sanitize_case_name(c: Column) -> Column:
    """Line breaks, also as tags, to spaces; runs of white space to one."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"(?U)\s+", " "))


def extract_title(raw: Column) -> Column:
    """The header's `title:`, else the first heading with text, else the first line with text, else 'Untitled'."""
    rows = F.transform(lines(raw), trimmed)
    state = F.struct(F.lit(0).alias("in"), F.lit("").alias("title"), F.lit(None).cast("string").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside, fence = a["in"] == 1, x == "---"
        opens = (a["in"] == 0) & fence
        given = F.regexp_replace(trimmed(F.regexp_extract(x, "(?s)^title:(.*)$", 1)), '(?s)^"(.*)"$', "$1")
        heading = trimmed(F.regexp_extract(x, "(?s)^#+ (.*)$", 1))
        free = a["out"].isNull() & ~inside & ~opens & (x != "")
        return F.struct(
            F.when(opens, 1).when(inside & fence, 2).otherwise(a["in"]).alias("in"),
            F.when(inside & x.startswith("title:") & (given != ""), given).otherwise(a["title"]).alias("title"),
            F.when(a["out"].isNotNull(), a["out"]).when(inside & fence & (a["title"] != ""), a["title"]).when(free & x.rlike("^#+ ") & (heading != ""), heading).when(free & ~x.rlike("^#+( |$)") | free & x.rlike("^#+$"), x).alias("out"),
        )

    return F.coalesce(F.aggregate(rows, state, step, lambda a: a["out"]), F.lit("Untitled"))


def normalize_embedding_text(c: Column, most: int = 2048) -> Column:
    """Binary: runs of blank, tab and line ends to one blank, none at the ends, cut to so many bytes."""
    one = F.regexp_replace(F.regexp_replace(c, "[ \n\t\r]+", " "), "^ ", "").cast("binary")
    cut = F.substring(one, 1, most)
    return F.when(F.endswith(cut, F.lit(b" ")), F.substring(cut, F.lit(1), F.octet_length(cut) - 1)).otherwise(cut)


def passage(c: Column) -> Column:
    return F.concat(F.lit(b"passage: "), normalize_embedding_text(c))


def question(c: Column) -> Column:
    return F.concat(F.lit(b"query: "), normalize_embedding_text(c))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Fixed values of the two-set keyboard: letters by key, and the letters that compose others.
KEYS = dict(zip("rRseEfaqQtTdwWczxvgkoiOjpuPhynbml", "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕㅖㅗㅛㅜㅠㅡㅣ", strict=True))
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
COMPOUND = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ", "ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ", "ㅂㅅ": "ㅄ"}
PARTS = {v: k for k, v in COMPOUND.items()}


def syllable(lead: str, vowel: str, tail: str) -> str:
    """The letters as one syllable if there is a lead and a vowel, else side by side."""
    if lead and vowel:
        return chr(0xAC00 + (LEADS.index(lead) * 21 + VOWELS.index(vowel)) * 28 + (TAILS.index(tail) if tail else 0))
    return lead + vowel + tail


def eng_to_hangul(text: str | None) -> str | None:
    """What the keys of a Latin layout give on the two-set layout; None if no key is one of its letters."""
    if text is None or not any(c in KEYS or c.lower() in KEYS for c in text):
        return None
    out, lead, vowel, tail = [], "", "", ""
    for c in text:
        letter = KEYS.get(c) or KEYS.get(c.lower())
        if letter is None:
            out += [syllable(lead, vowel, tail), c]
            lead = vowel = tail = ""
        elif letter in VOWELS:
            if tail:  # a tail, or its second half, leads the next syllable
                stays, goes = PARTS[tail] if tail in PARTS else ("", tail)
                out.append(syllable(lead, vowel, stays))
                lead, vowel, tail = goes, letter, ""
            elif vowel and vowel + letter in COMPOUND:
                vowel = COMPOUND[vowel + letter]
            elif vowel:
                out.append(syllable(lead, vowel, ""))
                lead, vowel = "", letter
            else:
                vowel = letter
        elif lead and vowel and (not tail and letter in TAILS or tail + letter in COMPOUND):
            tail = COMPOUND.get(tail + letter, letter) if tail else letter
        else:
            if lead or vowel:
                out.append(syllable(lead, vowel, tail))
            lead, vowel, tail = letter, "", ""
    return "".join([*out, syllable(lead, vowel, tail)])


def pop_jamo(text: str) -> str:
    """Without its last letter: a syllable loses its tail, then its vowel, then goes."""
    text = unicodedata.normalize("NFC", text)
    if not text:
        return ""
    head, last = text[:-1], text[-1]
    code = ord(last) - 0xAC00
    if 0 <= code < 11172:
        if code % 28:
            return head + chr(0xAC00 + code - code % 28)
        return head + LEADS[code // 588]
    return head


@F.pandas_udf(StringType())
def hangul_keys(c: pd.Series) -> pd.Series:
    return c.map(eng_to_hangul)


def display_width(text: str) -> int:
    """Columns that a terminal takes: two for wide letters, none for marks."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def fit_width(text: str, width: int) -> str:
    """Padded to a width, or cut with an ellipsis."""
    if display_width(text) <= width:
        return text + " " * (width - display_width(text))
    out = ""
    while text and display_width(out + text[0]) <= width - 1:
        out, text = out + text[0], text[1:]
    return out + "…" + " " * (width - 1 - display_width(out))
