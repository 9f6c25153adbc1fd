"""Column functions on words and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = r"[^\p{L}\p{N}_]"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def normalize_align(c: Column) -> Column:
    """Full-width signs to ASCII, then letters, digits and _ only."""
    return F.regexp_replace(F.translate(c, FULL_WIDTH, HALF_WIDTH), _NOT_WORD, "")


def normalize(c: Column) -> Column:
    return F.regexp_replace(c, _NOT_WORD, "")


def normalize_phrase(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s，。、！？,.!?]", "")


def char_ngrams(c: Column, n: int) -> Column:
    """All n-grams of characters with multiplicity; fewer characters give none.  The text is cut into characters once, so that
    a gram is a look-up of n of them and not a search from the text's beginning."""
    gram = lambda chars: lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
    all_of = F.transform(F.array(F.split(c, "")), lambda chars: F.transform(F.sequence(F.lit(0), F.length(c) - n), gram(chars)))
    return F.when(F.length(c) >= n, F.get(all_of, F.lit(0))).otherwise(F.array().cast("array<string>"))


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def timecode(us: Column) -> Column:
    """HH:MM:SS.mmm, rounded to milliseconds first."""
    ms = F.floor((us + 500) / 1000).cast("long")
    return F.concat(_pad(F.floor(ms / 3600000).cast("long"), 2), F.lit(":"), _pad(F.floor(ms / 60000).cast("long") % 60, 2), F.lit(":"), _pad(F.floor(ms / 1000).cast("long") % 60, 2), F.lit("."), _pad(ms % 1000, 3))


def timecode_short(us: Column) -> Column:
    """MM:SS.mmm; minutes may exceed 59."""
    ms = F.floor((us + 500) / 1000).cast("long")
    return F.concat(_pad(F.floor(ms / 60000).cast("long"), 2), F.lit(":"), _pad(F.floor(ms / 1000).cast("long") % 60, 2), F.lit("."), _pad(ms % 1000, 3))


def timecode_srt(us: Column) -> Column:
    return F.translate(timecode(F.greatest(us, F.lit(0))), ".", ",")


def timecode_ass(us: Column) -> Column:
    """H:MM:SS.cc, rounded to hundredths first."""
    cs = F.floor((F.greatest(us, F.lit(0)) + 5000) / 10000).cast("long")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), _pad(F.floor(cs / 6000).cast("long") % 60, 2), F.lit(":"), _pad(F.floor(cs / 100).cast("long") % 60, 2), F.lit("."), _pad(cs % 100, 2))


def parse_timecode(c: Column) -> Column:
    """HH:MM:SS.mmm, MM:SS or plain seconds -> microseconds; null for anything else."""
    p = F.split(c, ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    s = F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(p) == 2, part(1) * 60 + part(2)).when(F.size(p) == 1, part(1))
    return F.round(s * 1000000).cast("long")


def confidence_band(conf_milli: Column) -> Column:
    return F.when(conf_milli >= 800, "high").when(conf_milli >= 500, "mid").when(conf_milli.isNotNull(), "low")


def han_runs(c: Column) -> Column:
    """Runs of two Han characters and more."""
    return F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), F.lit(1))


def han_count(c: Column) -> Column:
    """Han characters of a text."""
    return F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""))


def breath_pad_us(pad_ms: Column) -> Column:
    return F.when(pad_ms > 0, pad_ms).otherwise(150) * 1000


def fix_words(c: Column, wrong_right: dict[str, str]) -> Column:
    """Replaces known misrecognitions, in order."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), wrong_right.items(), c)
