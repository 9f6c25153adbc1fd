"""ST2: pause segments as words arrive, with all that the batch form gives: text, word range, pads, least length, numbers.

An asset's open words are its state.  A run of words is closed when the watermark has passed its end by the pause: no word
that may still come can reach it or fall into it.  So chunks in any order within the delay give the batch's rows, late words
merge what stood apart, and words leave the state with their segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutloom.operators.segment import LEAST_US, PAD_US, PAUSE_US, pause_segments

_OUT = "asset_id long, start_us long, end_us long, n_words long, text string, first_idx int, last_idx int, mean_conf double, seg_id int"
_WORDS = ["word_idx", "word", "start_us", "end_us", "conf_milli", "at_us"]
_STATE = "n int, latest long, word_idx array<int>, word array<string>, start_us array<long>, end_us array<long>, conf_milli array<double>, at_us array<long>"


def _step(pause_us: int, pad_us: int, least_us: int, idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, latest, *columns = state.get if state.exists else (0, 0, *[[] for _ in _WORDS])
        words = {w[0]: w for w in zip(*columns)}
        for batch in batches:
            conf = batch["conf_milli"].astype(float)
            for w in zip(batch["word_idx"].astype(int), batch["word"], batch["start_us"].astype(int), batch["end_us"].astype(int), conf, batch["at_us"].astype(int)):
                words.setdefault(w[0], w)  # a word that comes again is the same
        order, rows = sorted(words.values()), []
        passed = state.getCurrentWatermarkMs() * 1000
        runs: list[list[tuple]] = []
        for w in order:
            if runs and w[2] - runs[-1][-1][3] < pause_us:
                runs[-1].append(w)
            else:
                runs.append([w])
        closes = lambda run: max(w[5] + w[3] - w[2] for w in run) + pause_us  # noqa: E731  in the stream's time
        while runs and closes(runs[0]) <= passed:
            done = runs.pop(0)
            start, end = max(min(w[2] for w in done) - pad_us, 0), max(w[3] for w in done) + pad_us
            known = [w[4] for w in done if w[4] == w[4]]
            if end - start >= least_us:
                n += 1
                text = " ".join(w[1] for w in done if w[1] is not None)
                rows.append((key[0], start, end, len(done), text, done[0][0], done[-1][0], sum(known) / len(known) if known else None, n))
        left = [w for run in runs for w in run]
        latest = max([latest, *(w[5] + w[3] - w[2] for w in order)])
        if not left and latest + idle_ms * 1000 <= passed:
            state.remove()
        else:
            state.update((n, latest, *([list(c) for c in zip(*left)] or [[] for _ in _WORDS])))
            until = closes(runs[0]) if left else latest + idle_ms * 1000
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def live_segments(words: DataFrame, delay: str = "10 minutes", pause_us: int = PAUSE_US, pad_us: int = PAD_US, least_us: int = LEAST_US, idle_ms: int = 86_400_000) -> DataFrame:
    """words(asset_id, word_idx, word, start_us, end_us, conf_milli, ts) -> what segment.pause_segments() gives, of a stream as
    segments close behind the watermark.

    ts: when a word starts, on the stream's time; within an asset it goes along with start_us.  Words that come later than delay
    are left out; words that come twice count once.  An asset without open words for idle_ms is given back, and counts from 1
    again after that."""
    if not words.isStreaming:
        return pause_segments(words.dropDuplicates(["asset_id", "word_idx"]))
    w = words.withWatermark("ts", delay).withColumn("at_us", F.unix_micros("ts")).select("asset_id", *_WORDS, "ts")
    return w.groupBy("asset_id").applyInPandasWithState(_step(pause_us, pad_us, least_us, idle_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
