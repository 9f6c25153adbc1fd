"""Where phrases are said first: many phrases in one pass over stretches of a recording's line of letters.

Stretches follow each other, each with the letters behind it that a phrase may need; a task builds one automaton of all
phrases that are looked for in a stretch and runs over its letters once.  No row holds a transcript, and a long recording
spreads over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.functions.text import normalize_phrase
from cutloom.operators.align import blocks_of, filled, line_of
from cutloom.sources.tables import staged

#: Letters of a block; starts in a stretch, which hold phrases of up to an eighth as many letters, longer ones have longer ones.
BLOCK, STRETCH, SHARE = 2048, 16384, 8

_FOUND = pa.schema([("asset_id", pa.int64()), ("q", pa.string()), ("at", pa.int64()), ("first_idx", pa.int32()), ("last_idx", pa.int32()), ("start_us", pa.int64()), ("end_us", pa.int64())])
_FIELDS = "asset_id long, q string, at long, first_idx int, last_idx int, start_us long, end_us long"


def _search(key: tuple, blocks: pa.Table, asked: pa.Table) -> pa.Table:
    import ahocorasick

    if not blocks.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    asset, wide, stretch = (k.as_py() for k in key)
    text, base, ends, (idx, _, starts_us, ends_us) = line_of(blocks["w"])
    automaton = ahocorasick.Automaton()
    for q in asked["q"].to_pylist():
        automaton.add_word(q, q)
    automaton.make_automaton()
    low, high = stretch * wide - base, (stretch + 1) * wide - base
    found: dict[str, int] = {}
    for last, q in automaton.iter(text, max(low, 0), min(high + wide // SHARE, len(text))):
        found.setdefault(q, last - len(q) + 1)
    rows = []
    for q, at in found.items():
        a, b = (int(np.searchsorted(ends, x, side="right")) for x in (at, at + len(q) - 1))
        rows.append((asset, q, base + at, idx[a], idx[b], starts_us[a], ends_us[b]))
    return pa.table(dict(zip(_FOUND.names, zip(*rows))), schema=_FOUND) if rows else _FOUND.empty_table()


def locate_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """words(asset_id, word_idx, word, start_us, end_us), phrases(asset_id, phrase) -> the words of the first occurrence in
    the asset's words without spaces and marks, or nulls; an empty or null phrase is found nowhere, equal ones each."""
    p = phrases.select("asset_id", "phrase", F.coalesce(normalize_phrase(F.col("phrase")), F.lit("")).alias("q"))
    blocks = staged(blocks_of(words, normalize_phrase, BLOCK), "phrase-blocks")
    asked = p.filter("q <> ''").select("asset_id", "q").distinct()
    wide = F.greatest(F.lit(STRETCH), F.pow(F.lit(2), F.ceil(F.log2(F.length("q") * SHARE)))).cast("long")
    asked = asked.withColumn("wide", wide)
    last = blocks.select("asset_id", F.element_at("w", -1)["e"].alias("e")).groupBy("asset_id").agg(F.max("e").alias("e"))
    asked = asked.join(last, "asset_id").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("e") - 1, F.lit(0)) / F.col("wide"))))).drop("e")
    around = F.sequence(F.floor(F.col("stretch") * F.col("wide") / BLOCK), F.floor((F.col("stretch") + 1 + 1 / SHARE) * F.col("wide") / BLOCK))
    lines = asked.select("asset_id", "wide", "stretch").distinct().withColumn("block", F.explode(around)).join(filled(blocks, BLOCK), ["asset_id", "block"])
    lines = lines.select("asset_id", "wide", "stretch", "w").toDF("asset", "of_wide", "of_stretch", "w")  # names of their own, as both sides come from asked
    found = lines.groupBy("asset", "of_wide", "of_stretch").cogroup(asked.groupBy("asset_id", "wide", "stretch")).applyInArrow(_search, _FIELDS)
    first = found.groupBy("asset_id", "q").agg(F.min(F.struct("at", "first_idx", "last_idx", "start_us", "end_us")).alias("f"))
    return p.join(first, ["asset_id", "q"], "left").select("asset_id", "phrase", "f.first_idx", "f.last_idx", "f.start_us", "f.end_us")
