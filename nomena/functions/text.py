"""Names, contexts and labels as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marks deleted from a name.
MARKS = "☆★○●◎◇◆□■▽▼△▲"
#: Fixed value: characters stripped from the ends of a name in a language with an alphabet.
ENDS = ".,;:!?'\"()[]{}«»"
#: Fixed value: noise that scanning left in mentions and titles.
SCAN_NOISE = r"[☆★＄＆◯●＝＋〇○]\(\d+[a-z]?\)|[？?]\(\d+[a-z]?\)|\(\d+[a-z]?\)|[☆★＄＆＝]"
#: White space as Python's str methods and patterns see it; a pattern that uses it begins with UNICODE. A class by property is some three times as fast as a list of the characters.
UNICODE, SPACE = "(?U)", r"[\s\x1c-\x1f]"
WITH_DIACRITICS = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ"
WITHOUT = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
YEAR_TOKEN = rf"{UNICODE}{SPACE}*\[年:[^\]]*\]{SPACE}*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """White space of any kind goes at both ends."""
    return F.regexp_replace(_text(c), rf"{UNICODE}^{SPACE}+|{SPACE}+$", "")


def _without(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def normalize_name(c: Column | str) -> Column:
    """White space goes, then marks, then what stands in half-width, full-width and angle brackets, in this order."""
    c = F.translate(_without(_text(c), rf"{UNICODE}{SPACE}+"), MARKS, "")
    return _without(c, r"\([^)]*\)", r"（[^）]*）", r"〈[^〉]*〉")


def base_name(c: Column | str) -> Column:
    """What stands in brackets of any kind goes, and all white space."""
    return _without(_text(c), r"〈[^〉]*〉|\([^)]*\)|（[^）]*）", rf"{UNICODE}{SPACE}+")


def mention_base(c: Column | str) -> Column:
    """Generation marks go everywhere, then one half-width bracket at the end, then one full-width one."""
    return strip(_without(_text(c), r"〈\d+〉", r"\([^)]*\)$", r"（[^）]*）$"))


def family_base(c: Column | str) -> Column:
    """The key of a family: generation marks go, then one half-width bracket at the end."""
    return strip(_without(_text(c), r"〈\d+〉", r"\([^)]*\)$"))


def squeeze(c: Column | str) -> Column:
    """Blanks of half and full width go."""
    return F.translate(_text(c), " 　", "")


def surface_key(c: Column | str) -> Column:
    """The form under which priors are counted."""
    return F.translate(strip(F.lower(_text(c))), "\"'", "")


def fold_known(c: Column | str) -> Column:
    """Latin letters lose their diacritics, by a table: stays in the JVM, letters beyond the table keep theirs."""
    return F.translate(_text(c), WITH_DIACRITICS, WITHOUT)


@F.pandas_udf(StringType())
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def fold_diacritics(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks. Texts of letters in the table and ASCII are folded in the JVM; only others go to Python."""
    known = fold_known(c)
    return F.when(known.rlike(r"^[\x00-\x7F]*$"), known).otherwise(_folded(_text(c)))


def normalize_generic(c: Column | str, lang: Column | str, fold=fold_diacritics) -> Column:
    """By the first two letters of the language: lower case (Sanskrit keeps its case), one blank between words, marks stripped from the ends once,
    German sharp s written out, diacritics folded but for Finnish and Sanskrit."""
    lang = F.left(F.lower(_text(lang)), F.lit(2))
    c = F.when(lang == "sa", _text(c)).otherwise(F.lower(_text(c)))
    c = F.btrim(F.btrim(F.regexp_replace(c, rf"{UNICODE}{SPACE}+", " ")), F.lit(ENDS))  # after the first step all white space is single blanks
    c = F.when(lang == "de", F.replace(c, F.lit("ß"), F.lit("ss"))).otherwise(c)
    return F.when(lang.isin("fi", "sa"), c).otherwise(fold(c))


def generation_number(title: Column | str) -> Column:
    """The number at the front of the first generation mark, 999 without one."""
    return F.coalesce(F.regexp_extract(_text(title), r"〈(\d+)", 1).try_cast("int"), F.lit(999))


def generation(name: Column | str) -> Column:
    """The digits of a whole generation mark, as text; null without one."""
    return F.nullif(F.regexp_extract(_text(name), r"〈(\d+)〉", 1), F.lit(""))


def strip_noise(c: Column | str) -> Column:
    return F.when(_col(c).isNotNull(), strip(_without(_text(c), SCAN_NOISE)))


def clean_title(c: Column | str) -> Column:
    """Without scanning noise and without the wide blank between family and given name."""
    return F.replace(strip_noise(c), F.lit("　"), F.lit(""))


def one_line(c: Column | str) -> Column:
    """Line ends and wide blanks turn into blanks, one for one: offsets stay."""
    return F.translate(_text(c), "\n\r　", "   ")


def split_context(sentence: Column | str, mention: Column | str) -> Column:
    """struct(left, right): the text around the first occurrence of the mention; without one, the whole sentence is the left side."""
    s, m = _text(sentence), _text(mention)
    at = F.instr(s, m)
    here = (at > 0) & (F.length(m) > 0)
    return F.struct(F.when(here, F.left(s, at - 1)).otherwise(s).alias("left"), F.when(here, F.substr(s, at + F.length(m))).otherwise(F.lit("")).alias("right"))


def lineage_cue(text: Column | str, entity_id: Column) -> Column:
    """What tells entities of one title apart: the lineage in brackets, else the poet's name, the house name or the common name, of eight characters at most; else the id.

    The patterns are fixed values, tried in order; a poet's name that only says there is none doesn't count.
    """
    t = _text(text)
    found = [strip(F.regexp_extract(t, p, 1)) for p in (r"\(([^()（）\n]{0,3}系)\)", r"（([^()（）\n]{0,3}系)）", r"俳名・狂歌名[:：]\s*([^\s（(屋号家系\n]+)", r"屋号[:：]\s*([^\s（(\n]+)", r"本名[:：]\s*【通】\s*([^\s\n]+)")]
    fits = [F.when((F.length(x) > 0) & (F.length(x) <= 8) & (~x.isin("—", "無", "？") if i == 2 else F.lit(True)), x) for i, x in enumerate(found)]
    return F.coalesce(*fits, F.concat(F.lit("id"), entity_id.cast("string")))


def percent_encoded(c: Column | str) -> Column:
    """As in the path of an address: blanks become %20, a slash stays."""
    c = F.url_encode(_text(c))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def person_address(base: str, detail_id: Column, headline: Column, headline_generation: Column, title: Column) -> Column:
    """The address of a person's page: by headline name and generation, which names one person, or else by a search for the name; null without a detail id or a name."""
    brackets = r"〈[^〉]*〉|\([^)]*\)|（[^）]*）"
    name = F.when(F.length(_text(headline)) > 0, headline).otherwise(title)
    exact = F.concat(F.lit(f"{base}?f2[]="), percent_encoded(strip(_without(_text(headline), brackets))), F.lit("&f3="), percent_encoded(headline_generation.cast("string")), F.lit("&-format=results-2p.htm&-max=1&enter=default"))
    search = F.concat(F.lit(f"{base}?f43[]="), percent_encoded(strip(squeeze(_without(_text(name), brackets)))), F.lit("&-format=results-2p.htm&-max=50&enter=default"))
    known = (F.length(_text(headline)) > 0) & (F.length(_text(headline_generation.cast("string"))) > 0)
    return F.when((F.length(_text(detail_id.cast("string"))) > 0) & (F.length(_text(name)) > 0), F.when(known, exact).otherwise(search))


def candidate_label(entity_id: Column, title: Column, reading: Column, birth: Column, death: Column) -> Column:
    """id, title, reading and years, set apart by wide bars; what is unknown is left out."""
    year = lambda y: F.coalesce(F.nullif(y, F.lit(0)).cast("string"), F.lit("?"))
    years = F.when((F.coalesce(birth, F.lit(0)) != 0) | (F.coalesce(death, F.lit(0)) != 0), F.concat(year(birth), F.lit("-"), year(death)))
    return F.concat_ws("｜", entity_id.cast("string"), title, F.nullif(squeeze(reading), F.lit("")), years)


def marked_input(left: Column, mention: Column, right: Column, n: int = 128) -> Column:
    """A model's input: the mention between marks and n characters of context on each side."""
    return F.concat(F.right(_text(left), F.lit(n)), F.lit(" [START] "), _text(mention), F.lit(" [END] "), F.left(_text(right), F.lit(n)))


def window_context(left: Column, right: Column, n: int) -> tuple[Column, Column]:
    """The last n characters of the left context, keeping a closing year token with the white space around it, and the first n of the right one; n of 0 keeps all of the left one, as a slice from -0 does."""
    whole = _text(left)
    token = F.regexp_extract(whole, rf"({YEAR_TOKEN})", 1)
    body = F.regexp_replace(whole, YEAR_TOKEN, "")
    return F.concat(F.right(body, F.lit(n)) if n else body, token), F.left(_text(right), F.lit(n))


def year_token(year: Column, book: Column) -> Column:
    shown = F.when(F.coalesce(year, F.lit(0)) == 0, F.lit("?")).otherwise(year.cast("string"))
    return F.concat(F.lit(" [年:"), shown, F.lit("|書:"), F.replace(_text(book), F.lit("|"), F.lit("/")), F.lit("] "))


def recut(page: Column, start: Column, end: Column, mention: Column, left: Column, right: Column, n: int) -> Column:
    """struct(left, right, aligned): contexts of n characters cut anew from the page where the offsets meet the mention, the year token kept; else as they were."""
    aligned = F.coalesce(F.substring(page, start + 1, end - start) == mention, F.lit(False)) & (start >= 0) & (end >= start)
    token = F.regexp_extract(_text(left), r"(\s*\[年:[^\]]*\]\s*)$", 1)
    low = F.greatest(start - n, F.lit(0))
    new_left = F.concat(one_line(F.substring(page, low + 1, start - low)), token)
    new_right = one_line(F.substring(page, end + 1, F.lit(n)))
    ok = F.coalesce(aligned, F.lit(False))
    return F.struct(F.when(ok, new_left).otherwise(left).alias("left"), F.when(ok, new_right).otherwise(right).alias("right"), ok.alias("aligned"))


def outer_json(c: Column | str) -> Column:
    """The text from the first { to the last }, or null."""
    found = F.regexp_extract(_text(c), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
