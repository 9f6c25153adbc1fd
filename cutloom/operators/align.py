"""Script alignment: where sentences of a script are said in a transcript.

1. Words go to the bands of their recording's line of letters that need them; a band has at least 2^14 starts, so that most
   recordings are one row, and no row holds a long transcript.
2. Sentences meet bands as lists, those of the band's recording or all.  A task finds the places that each sentence of a list
   shares with a band in one pass over sorted 4-grams, and scores the sentences that share as many within a window's reach as
   a match must.
3. Of a sentence, only starts are scored that lie ahead of a shared place from which a match may begin.
4. Peaks that stand close have equal scores; the first of them stays, by a scan over sorted partitions.

Neither grams nor pairs of sentence and band are rows: what moves grows with words and sentences, not with common grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.text import normalize_align
from cutloom.operators.segment import by_word, running_sum, uncovered_runs
from cutloom.sources.tables import by_asset, staged

GRAM, LEAST, SHORT, LONG, RADIUS, SURE = 4, 0.25, 0.65, 2.2, 0.8, 500
#: Letters in a block of a line; sentences of up to 2^k letters, k at least CLASS, have bands of WIDTH * 2^k starts.
BLOCK, CLASS, WIDTH = 512, 10, 16
#: Sentences in a list; windows and, about, letters that are scored at a time.
LIST, CELLS, LETTERS = 1000, 100_000, 4096


def places_of(text: str, n: int = GRAM) -> dict[str, list[int]]:
    """Where each gram of a text stands."""
    out: dict[str, list[int]] = {}
    for p in range(len(text) - n + 1):
        out.setdefault(text[p : p + n], []).append(p)
    return out


def scores(sentence: str, text: str, n: int = GRAM, first: int = 0, stop: int | None = None, least: float = 0.0, places: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best F1 of any window that starts at each position from first to stop, and where the shortest best window ends.

    Scores below least may be given as 0.  A gram counts in a window unless it stands there as often before as in the
    whole sentence; so each shared place needs only the place where its gram stood that many times before."""
    places = places_of(text, n) if places is None else places
    wanted: dict[str, int] = {}
    for k in range(len(sentence) - n + 1):
        wanted[sentence[k : k + n]] = wanted.get(sentence[k : k + n], 0) + 1
    found = []
    for g, k in wanted.items():
        seen = places.get(g, ())
        found += [(p, -1 if i < k else seen[i - k]) for i, p in enumerate(seen)]
    place, before = np.array(sorted(found), dtype=np.int64).reshape(-1, 2).T
    return shared_scores(place, before, len(sentence), len(text), n, first, len(text) if stop is None else stop, least)


def reach_of(q, n: int = GRAM, least: float = LEAST) -> tuple:
    """Of sentences of q letters: the least and the most letters of a window, and how many shared grams a match needs."""
    low, high = np.maximum(n, (q * SHORT).astype(np.int64) if isinstance(q, np.ndarray) else int(q * SHORT)), np.floor(q * LONG).astype(np.int64) + 1
    return low, high, np.maximum(1, np.ceil(least / 2 * (low - n + 1 + np.maximum(0, q - n + 1)) - 1e-9).astype(np.int64))


def _over(place: np.ndarray, before: np.ndarray, start: np.ndarray, k: np.ndarray, low: int, total: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """F1 and length of the windows from each start that end with each of its places k."""
    over = np.cumsum(before[k] < start, axis=1, dtype=place.dtype)
    length = np.maximum(place[k] - start + n, low)
    return 2.0 * over / (length - n + 1 + total), length


def shared_scores(place: np.ndarray, before: np.ndarray, q: int, size: int, n: int, first: int, stop: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """scores() from the shared places, ascending, of a sentence of q letters in a text of that size."""
    low, high, need = (int(x) for x in reach_of(q, n, least))
    start, lengths, total = np.arange(first, stop), high - n + 1, max(0, q - n + 1)
    best, end = np.zeros(len(start)), np.minimum(start + low, size)
    if not len(place) or lengths <= 0:
        return best, end
    kind = np.int32 if 2 * size + high < 1 << 30 else np.int64
    ahead = np.arange(len(place))
    reach = np.searchsorted(place, place + lengths) - ahead
    # Ahead of a place the same grams are shared up to the place before, by longer windows: no start there is better than the place.
    hopeful = np.flatnonzero(reach >= need)
    most = int(reach.max())
    place, before = (np.append(x, np.full(most, v)).astype(kind) for x, v in ((place, 2 * size + high), (before, size)))
    if least > 0:
        good = np.zeros(len(hopeful), dtype=bool)
        for at in range(0, len(hopeful), step := max(1, CELLS // most)):
            i = hopeful[at : at + step]
            f1, length = _over(place, before, place[i, None], i[:, None] + np.arange(reach[i].max()), low, total, n)
            good[at : at + step] = np.where(length <= high, f1, 0.0).max(axis=1) >= least
        hopeful = hopeful[good]
    from_ = np.maximum(np.maximum(np.append(-1, place)[hopeful] + 1, place[hopeful] - lengths + 1), first)
    many = np.maximum(np.minimum(place[hopeful] + 1, stop) - from_, 0)
    begin = np.repeat(hopeful, many)
    tried = np.repeat(from_ - np.cumsum(many) + many, many) + np.arange(many.sum())
    count = np.searchsorted(place[: len(ahead)], tried + lengths) - begin
    some = count >= need
    begin, tried, count = begin[some], tried[some].astype(kind), count[some]
    # The shortest window that holds so many shared grams ends with one of them, or has the least length.
    for at in range(0, len(tried), step := max(1, CELLS // most)):
        s, row = tried[at : at + step], slice(at, at + step)
        f1, length = _over(place, before, s[:, None], begin[row, None] + np.arange(count[row].max()), low, total, n)
        f1 = np.where((length <= high) & (s[:, None] + length <= size), f1, 0.0)
        top = f1.argmax(axis=1)
        value, length = f1[np.arange(len(s)), top], length[np.arange(len(s)), top]
        some = value > 0
        best[s[some] - first], end[s[some] - first] = value[some], s[some] + length[some]
    return best, end


def local_maxima(best: np.ndarray, radius: int, least: float = LEAST) -> list[int]:
    """Positions of at least least that no position within radius exceeds."""
    at = np.flatnonzero(best >= least)
    if not len(at):
        return []
    top, span = np.pad(best[at[0] : at[-1] + 1], radius), 1  # lower values around don't count
    while 2 * span <= 2 * radius + 1:
        top, span = np.maximum(top[:-span], top[span:]), 2 * span
    place = at - at[0]
    return at[best[at] >= np.maximum(top[place], top[place + 2 * radius + 1 - span])].tolist()


def first_of_close(positions: list[int], radius: int) -> list[int]:
    """Of ascending positions nearer than radius to one that stays, only that one."""
    kept: list[int] = []
    for i in positions:
        if not kept or i - kept[-1] >= radius:
            kept.append(i)
    return kept


def peaks(best: np.ndarray, radius: int, least: float = LEAST) -> list[int]:
    """Local maxima; of those nearer than radius, which are equal, the first."""
    return first_of_close(local_maxima(best, radius, least), radius)


def radius_of(q: int) -> int:
    return max(GRAM, int(q * RADIUS))


def radii(q: np.ndarray) -> np.ndarray:
    """radius_of() of each."""
    return np.maximum(GRAM, (q * RADIUS).astype(np.int64))


_WORD = ("word_idx", "n", "e", "c", "start_us", "end_us")


def on_line(words: DataFrame, normal=normalize_align, spread: bool = True) -> DataFrame:
    """words(asset_id, word_idx, word, start_us, end_us, [conf_milli]) -> their normal letters n, where these end on the line of
    the recording's letters, and confidence c.  Not spread: one sum over a recording, for which words that stand by asset_id
    needn't move."""
    sure = F.coalesce(F.col("conf_milli").cast("double"), F.lit(0.0)) if "conf_milli" in words.columns else F.lit(0.0)
    w = words.select("asset_id", "word_idx", F.coalesce(normal(F.col("word")), F.lit("")).alias("n"), sure.alias("c"), "start_us", "end_us")
    w = w.withColumn("size", F.length("n").cast("long"))
    return running_sum(w, "size", "e") if spread else w.withColumn("e", F.sum("size").over(by_word().rowsBetween(Window.unboundedPreceding, 0)))


def blocks_of(words: DataFrame, normal=normalize_align, size: int = BLOCK) -> DataFrame:
    """asset_id, block, w: the words that begin in each block of the line of normal letters, in order, with where they end on it.
    Words without letters stand where the line goes on."""
    w = on_line(words, normal)
    w = w.withColumn("block", F.floor((F.col("e") - F.col("size")) / size))
    return w.groupBy("asset_id", "block").agg(F.array_sort(F.collect_list(F.struct(*_WORD))).alias("w"))


_FOUND = pa.schema([
    ("asset_id", pa.int64()), ("norm", pa.string()), ("p", pa.int64()), ("first_idx", pa.int32()), ("last_idx", pa.int32()),
    ("start_us", pa.int64()), ("end_us", pa.int64()), ("f1", pa.float64()), ("confidence", pa.float64()),
])
_FIELDS = "asset_id long, norm string, p long, first_idx int, last_idx int, start_us long, end_us long, f1 double, confidence double"


def line_of(blocks: pa.ChunkedArray) -> tuple[str, int, np.ndarray, list[np.ndarray]]:
    """The letters of blocks that follow each other, where they begin on the line, where each word ends in them, and the words'
    numbers, confidence and times."""
    lines = {v[0].as_py()["word_idx"]: v for v in (x.values for x in blocks)}  # a block comes once for each number it covers
    w = pa.concat_arrays([lines[i] for i in sorted(lines)])
    parts, ends = w.field("n").to_pylist(), w.field("e").to_numpy()
    base = int(ends[0]) - len(parts[0])
    return "".join(parts), base, ends - base, [w.field(f).to_numpy() for f in ("word_idx", "c", "start_us", "end_us")]


class Script:
    """A list of sentences by their grams: which sentences hold each, and how often."""

    def __init__(self, norms: list[str]):
        self.norms, self.q, self.bits = norms, np.array([len(x) for x in norms]), len(norms).bit_length()
        codes = self._codes("".join(norms))
        pairs = codes[:-1] << 32 | codes[1:]
        self.pairs = np.unique(pairs)
        at = np.searchsorted(self.pairs, pairs)
        size = self.q - GRAM + 1
        p = np.arange(size.sum()) + np.repeat(np.cumsum(self.q) - self.q - np.cumsum(size) + size, size)
        self.grams, gram = np.unique(at[p] << 32 | at[p + 2], return_inverse=True)
        both, self.times = np.unique(gram.astype(np.int64) << 32 | np.repeat(np.arange(len(norms)), size), return_counts=True)
        self.sentence = both & 0xFFFFFFFF
        self.holders = np.searchsorted(both >> 32, np.arange(len(self.grams) + 1))
        self.reach, self.radius = reach_of(self.q), radii(self.q)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)

    def _known(self, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Where values stand in a sorted table, -1 for those that don't."""
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return np.where(table[at] == values, at, -1)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, sentence, place, before of the places that texts share with the sentences that may match in them, in this order;
        before: where a place's gram stood as often before as the sentence holds it, or -1."""
        codes, sizes = self._codes("".join(texts)), np.array([len(x) for x in texts])
        none = (np.empty(0, dtype=np.int64),) * 4
        if len(codes) < GRAM:
            return none
        text = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pair = self._known(self.pairs, codes[:-1] << 32 | codes[1:])
        may = np.flatnonzero((pair[:-2] >= 0) & (pair[2:] >= 0) & (text[: -GRAM + 1] == text[GRAM - 1 :]))
        gram = self._known(self.grams, pair[may] << 32 | pair[may + 2])
        place, gram = may[gram >= 0], gram[gram >= 0]
        if not len(place):
            return none
        own = text[place] * len(self.grams) + gram
        order = np.argsort(own, kind="stable")
        place, gram, own = place[order], gram[order], own[order]
        opens = np.flatnonzero(np.diff(own, prepend=-1))  # where each gram's places in a text begin
        opens = np.repeat(opens, np.diff(opens, append=len(own)))
        size = self.holders[gram + 1] - self.holders[gram]
        of = np.repeat(np.arange(len(place)), size)
        holder = np.arange(len(of)) + np.repeat(self.holders[gram] - np.cumsum(size) + size, size)
        back = of - self.times[holder]
        before = np.where(back >= opens[of], at[place[np.maximum(back, 0)]], -1)
        own, place = (text[place] << self.bits)[of] | self.sentence[holder], at[place][of]
        wide = int(sizes.max()).bit_length()
        if len(texts).bit_length() + self.bits + 2 * wide < 63:  # rows as numbers sort much faster than their order
            row = np.sort((own << wide | place) << wide | before + 1)
            own, place, before = row >> 2 * wide, row >> wide & (1 << wide) - 1, (row & (1 << wide) - 1) - 1
        else:
            order = np.lexsort((place, own))
            own, place, before = own[order], place[order], before[order]
        _, high, need = self.reach
        sentence = own & (1 << self.bits) - 1
        last = np.arange(len(place)) + need[sentence] - 1
        inside = np.minimum(last, len(place) - 1)
        enough = (last < len(place)) & (own[inside] == own) & (place[inside] - place <= (high - GRAM)[sentence])
        some = np.zeros(len(texts) << self.bits, dtype=bool)
        some[own[enough]] = True
        some = some[own]
        return own[some] >> self.bits, sentence[some], place[some], before[some]

    def shared(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each sentence that may match in a text, with its shared places and where their grams stood as often before as the
        sentence holds them."""
        _, sentence, place, before = self.hits([text])
        for i in np.unique(sentence).tolist():
            own = slice(*np.searchsorted(sentence, [i, i + 1]))
            yield i, place[own], before[own]

    def peaks(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """text, sentence, first, last, length, value, chained: the stretches of starts that are local maxima of a sentence's scores
        within radius_of() its length; their windows have one length and value.  chained: a maximum nearer than the radius may
        stand ahead of the first.

        All sentences and texts at once, and of starts only shared places: between two of them a start's windows hold what the
        next place's hold, so that scores rise up to it, and are level where the best window has the least length."""
        text, sentence, place, before = self.hits(texts)
        if not len(place):
            return (text,) * 7
        low_of, high_of, need_of = self.reach
        sizes, total_of = np.array([len(x) for x in texts]), np.maximum(0, self.q - GRAM + 1)
        own = text << self.bits | sentence
        prev = np.where(np.diff(own, prepend=-1) == 0, np.append(-1, place[:-1]), -1)
        low, lengths = low_of[sentence], (high_of - GRAM + 1)[sentence]
        start = np.minimum(place, sizes[text] - low)  # the last start that a window fits behind
        nth = np.arange(len(place))
        last = nth + need_of[sentence] - 1
        inside = np.minimum(last, len(place) - 1)
        hopeful = (start > prev) & (last < len(place)) & (own[inside] == own) & (place[inside] < start + lengths)
        # With all grams counted, some window must reach LEAST: 2 / LEAST * grams less letters, at most, from here on.
        far, most = int(2 / LEAST * len(place)) + int(sizes.max()) + 1, 2 / LEAST * (nth + 1) - place
        most = np.maximum.accumulate((most - own * far)[::-1])[::-1] + own * far
        hopeful = np.flatnonzero(hopeful & (most >= 2 / LEAST * nth + 1 + total_of[sentence] - start))
        if not len(hopeful):
            return (text[:0],) * 7
        wide = int(sizes.max() + high_of.max()) + 1
        key = own * wide + place
        reach = np.searchsorted(key, own[hopeful] * wide + start[hopeful] + lengths[hopeful]) - hopeful

        def cells(at: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
            """Of the windows from the start of places at, to each of many shared places: where those of one start begin, the place,
            the shared grams and the least length."""
            opens = np.cumsum(many) - many
            k = np.repeat(at - opens, many) + np.arange(many.sum())
            new = before[k] < np.repeat(start[at], many)
            over = np.cumsum(new)
            over -= np.repeat(over[opens] - new[opens], many)
            return opens, k, over, np.maximum(place[k] - np.repeat(start[at] - GRAM, many), np.repeat(low[at], many))

        found = []
        bounds = np.searchsorted(np.cumsum(reach), np.arange(CELLS, int(reach.sum()) + CELLS, CELLS), side="right")
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(hopeful)]):
            if a == b:
                continue
            at, many = hopeful[a:b], reach[a:b]
            opens, k, over, length = cells(at, many)
            f1 = 2.0 * over / (length + np.repeat(total_of[sentence[at]] - GRAM + 1, many))
            best = np.maximum.reduceat(f1, opens)
            good = np.flatnonzero(best >= LEAST)
            top = np.flatnonzero(f1 == np.repeat(np.where(best >= LEAST, best, -1.0), many))
            top = top[np.searchsorted(top, opens[good])]  # the shortest of the best
            found.append((at[good], many[good], best[good], k[top], over[top], length[top]))
        at, many, value, end, over, length = (np.concatenate(x) for x in zip(*found))
        own, z, r, floor, s, prev, total = own[at], sentence[at], self.radius[sentence[at]], low[at], start[at], prev[at], total_of[sentence[at]]
        bulk = length - GRAM + 1 + total  # value is 2 * over / bulk
        first = np.where(length == floor, np.maximum(prev + 1, place[end] + GRAM - floor), s)
        clipped, stop, chained = first.copy(), s.copy(), np.zeros(len(at), dtype=bool)
        # Starts within the radius of a higher place ahead are none.
        h, d = np.arange(len(at)), 1
        while len(h := h[h >= d]):
            h = h[(own[h - d] == own[h]) & (s[h - d] + r[h] >= clipped[h])]
            g = h - d
            higher = value[g] > value[h]
            chained[h] |= (value[g] == value[h]) & (s[g] > clipped[h] - r[h])
            clipped[h[higher]] = s[g[higher]] + r[h[higher]] + 1
            h, d = h[~higher], d + 1
        h, d = np.flatnonzero(clipped <= stop), 1
        while len(h := h[h + d < len(at)]):
            g = h + d
            near = (own[g] == own[h]) & (prev[g] < stop[h] + r[h])
            h, g = h[near], g[near]
            higher = value[g] > value[h]
            whole = higher & (s[g] <= clipped[h] + r[h])
            stop[h[whole]] = -1
            part = higher & ~whole
            if part.any():
                # The first start up to a place from which a window scores higher, in whole numbers.
                x, y = h[part], g[part]
                opens, k, o, _ = cells(at[y], many[y])
                n, m = np.repeat(over[x], many[y]), o * np.repeat(bulk[x], many[y])
                t = np.maximum(((place[k] + 1 + np.repeat(total[y], many[y])) * n - m) // n, np.repeat(prev[y], many[y])) + 1
                t = np.maximum(t, place[k] - np.repeat(lengths[at[y]], many[y]) + 1)
                t[np.repeat(floor[y] - GRAM + 1 + total[y], many[y]) * n >= m] = np.iinfo(np.int64).max
                stop[x] = np.minimum(stop[x], np.minimum.reduceat(t, opens) - r[x] - 1)
            h, d = h[stop[h] >= clipped[h]], d + 1
        stay = np.flatnonzero(clipped <= stop)
        return text[at[stay]], z[stay], clipped[stay], stop[stay], length[stay], value[stay], chained[stay]


def _score(rows: list[tuple], script: Script) -> pa.RecordBatch | None:
    """The local maxima of a list's sentences in bands.  Of starts on a level that no other maximum is near, only the first."""
    lines = []
    for asset, size_class, band, words in rows:
        parts, ends = words.field("n").to_pylist(), words.field("e").to_numpy()
        base = int(ends[0]) - len(parts[0])
        low = band * WIDTH * 2**size_class - base
        text = "".join(parts)
        lines.append((text, ends - base, base, max(low, 0), min(low + WIDTH * 2**size_class, len(text))))
    line, z, first, last, length, value, chained = script.peaks([x[0] for x in lines])
    low, high = (np.array([x[i] for x in lines])[line] for i in (3, 4))
    chained = chained | (first < low)
    first, last = np.maximum(first, low), np.minimum(last, high - 1)
    many = np.where(chained, np.maximum(last - first + 1, 0), first <= last)
    of = np.repeat(np.arange(len(many)), many)
    if not len(of):
        return None
    p = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    line, z, value, end = line[of], z[of], value[of], p + length[of] - 1
    # The words of all bands in one line, each band's letters behind those before.
    sizes = np.array([len(x[0]) for x in lines])
    ahead, of_words = np.cumsum(sizes) - sizes, [len(x[1]) for x in lines]
    ends = np.concatenate([x[1] for x in lines]) + np.repeat(ahead, of_words)
    idx, conf, starts_us, ends_us = (np.concatenate([w.field(f).to_numpy() for *_, w in rows]) for f in ("word_idx", "c", "start_us", "end_us"))
    a, b = (np.searchsorted(ends, x + ahead[line], side="right") for x in (p, end))
    conf = np.append(0.0, np.cumsum(conf))
    factor = np.where((conf[b + 1] - conf[a]) / (b + 1 - a) >= SURE, 1.0, 0.85)
    final = np.round(value * factor, 4)  # as SQL's round_even(); Python's round() says 0.3187 of 0.85 * 0.375
    asset, base = (np.array([x[0] for x in rows])[line], np.array([x[2] for x in lines])[line])
    columns = (asset, pa.array(script.norms, pa.string()).take(pa.array(z)), base + p, idx[a], idx[b], starts_us[a], ends_us[b], value, final)
    return pa.record_batch([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _score_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    script, rows, letters = None, [], 0
    for batch in batches:
        for asset, size_class, band, words, norms in zip(*(batch[c] for c in ("asset_id", "size_class", "band", "w", "norms"))):
            norms = norms.values.to_pylist()
            if script is None or script.norms != norms or letters >= LETTERS:
                if rows and (out := _score(rows, script)):
                    yield out
                rows, letters = [], 0
                if script is None or script.norms != norms:
                    script = Script(norms)
            rows.append((asset.as_py(), size_class.as_py(), band.as_py(), words.values))
            letters += int(words.values[-1]["e"].as_py()) - int(words.values[0]["e"].as_py())
    if rows and (out := _score(rows, script)):
        yield out


def _first_peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by asset_id, norm and p without those nearer than the radius to one that stays."""
    asset = norm = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        assets, norms, p = batch["asset_id"].to_numpy(), batch["norm"], batch["p"].to_numpy()
        r = radii(pc.utf8_length(norms).to_numpy())
        # A maximum far enough from the one before it stays, whether that one does or not.
        same = (assets[1:] == assets[:-1]) & pc.equal(norms[1:], norms[:-1]).to_numpy(zero_copy_only=False)
        near = np.append((assets[0], norms[0].as_py()) == (asset, norm), same & (p[1:] - p[:-1] < r[1:]))
        stays = ~near
        for i in np.flatnonzero(near).tolist():
            last = p[i - 1] if i and stays[i - 1] else last
            stays[i] = p[i] - last >= r[i]
        asset, norm, last = assets[-1], norms[-1].as_py(), p[-1] if stays[-1] else last
        yield batch.filter(pa.array(stays))


def align(words: DataFrame, sentences: DataFrame, spread: bool = False) -> DataFrame:
    """words(asset_id, word_idx, word, start_us, end_us, conf_milli), sentences([asset_id,] [item_id,] sent_id,
    text) -> matches with word ranges and confidence; keep and reason: of several matches of a sentence only the latest stays, by
    start, end and place.

    Sentences with an asset_id are looked for in this recording only, others in all.  Sentences of fewer than 4 letters match
    nothing.  Null words count as empty, null confidence as 0; an equal sentence is scored once and counts each time.

    Words meet sentences by asset_id alone, or lists that come to them, so that words that stand by it don't move, whatever the
    size of the tables.  spread: for recordings of very many words, no task holds all words of one; words move twice."""
    own = ["asset_id"] if "asset_id" in sentences.columns else []
    ids = ["asset_id", *[c for c in ("item_id", "sent_id") if c in sentences.columns]]
    s = sentences.select(*own, *ids[1:], normalize_align(F.col("text")).alias("norm")).filter(F.length("norm") >= GRAM)
    if own and not spread:
        met = _own_bands(words, s)
        s = s.hint("merge")
    else:
        lists = _lists(s.select(*own, "norm").distinct(), own)
        met = _bands(words, lists, own, spread).join(lists, [*own, "size_class"])
    found = met.select("asset_id", "size_class", "band", "w", "norms").mapInArrow(_score_bands, _FIELDS)
    found = found.repartition("asset_id", "norm").sortWithinPartitions("asset_id", "norm", "p").mapInArrow(_first_peaks, _FIELDS)
    found = found.filter(F.col("confidence") >= LEAST).join(s, [*own, "norm"]).select(*ids, "p", "first_idx", "last_idx", "start_us", "end_us", "f1", "confidence")
    w5 = Window.partitionBy(*ids)
    late = F.row_number().over(w5.orderBy(F.desc("start_us"), F.desc("end_us"), F.desc("p")))
    found = found.withColumns({"interval_idx": F.row_number().over(w5.orderBy("start_us", "end_us", "p")) - 1, "keep": late == 1}).drop("p")
    return found.withColumn("reason", F.when(F.col("keep"), "").otherwise("repeat_discard"))


def summary(words: DataFrame, sentences: DataFrame, found: DataFrame) -> DataFrame:
    """A1: found, as align() gives it -> for each asset (and item, where sentences have items) with a match: sentences, matched,
    unmatched and repeated ones, the match rate to 4 decimals, and the asset's runs of words outside all matches."""
    script = [c for c in ("asset_id", "item_id") if c in sentences.columns]
    keys = ["asset_id", *[c for c in script if c != "asset_id"]]
    found = staged(found, "matches")  # counted and covered with; scored once
    m = found.groupBy(*keys, "sent_id").agg(F.count("*").alias("n"))
    m = m.groupBy(*keys).agg(F.count("*").alias("matched"), F.count_if(F.col("n") > 1).alias("repeats"))
    out = m.join(sentences.groupBy(*script).agg(F.count("*").alias("sentences")), script)
    left = uncovered_runs(words, found).groupBy("asset_id").agg(F.count("*").alias("adlibs"))
    out = out.join(left, "asset_id", "left").withColumn("adlibs", F.coalesce("adlibs", F.lit(0)))
    return out.withColumns({"unmatched": F.col("sentences") - F.col("matched"), "match_rate": F.round(F.col("matched") / F.col("sentences"), 4)})


def _size_class(norm: Column) -> Column:
    return F.greatest(F.lit(CLASS), F.ceil(F.log2(F.length(norm)))).cast("int")


def _lists(s: DataFrame, own: list[str]) -> DataFrame:
    """size_class, norms [, asset_id]: sentences of like lengths in lists of about LIST."""
    s = s.withColumn("size_class", _size_class(F.col("norm")))
    keys = [*own, "size_class"]
    n = s.groupBy(*keys).agg(F.ceil(F.count("*") / LIST).alias("_lists"))
    s = s.join(n, keys).withColumn("_list", F.pmod(F.xxhash64("norm"), "_lists"))
    return s.groupBy(*keys, "_list").agg(F.collect_list("norm").alias("norms")).drop("_list")


def _bands(words: DataFrame, lists: DataFrame, own: list[str], spread: bool = True) -> DataFrame:
    """asset_id, size_class, band, w: the words, in order and with where they end on the line, around each band of each size
    class that sentences of the recording have, as far as peaks and windows of the band's starts need letters."""
    w = on_line(words.filter("asset_id is not null"), spread=spread)
    classes = lists.select(*own, "size_class").distinct()
    return _banded(w.join(classes, own) if own else w.crossJoin(F.broadcast(classes)))


def _banded(w: DataFrame) -> DataFrame:
    wide, margin = F.lit(WIDTH) * F.expr("shiftleft(1L, size_class)"), F.expr("shiftleft(1L, size_class)")
    first, last = F.floor((F.col("e") - F.length("n") - 4 * margin) / wide), F.floor((F.col("e") + margin) / wide)
    w = w.withColumn("band", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
    return w.groupBy("asset_id", "size_class", "band").agg(F.array_sort(F.collect_list(F.struct(*_WORD))).alias("w"))


def _own_bands(words: DataFrame, s: DataFrame) -> DataFrame:
    """asset_id, size_class, band, w, norms: bands with lists of their own recording's sentences.  Every join is by asset_id alone,
    by which words and sentences stand already, and none broadcasts; a recording's sentences come as one row."""
    own = by_asset(s).groupBy("asset_id").agg(F.collect_set("norm").alias("all")).hint("merge")
    classes = own.select("asset_id", F.array_distinct(F.transform("all", _size_class)).alias("classes"))
    w = on_line(words, spread=False).join(classes, "asset_id").withColumn("size_class", F.explode("classes")).drop("classes")
    j = _banded(w).join(own, "asset_id").withColumn("all", F.filter("all", lambda x: _size_class(x) == F.col("size_class")))
    j = j.withColumn("_list", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / LIST).cast("int"))))
    return j.select("asset_id", "size_class", "band", "w", F.slice("all", F.col("_list") * LIST + 1, LIST).alias("norms"))


def filled(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks, by every number that their words reach into."""
    last = F.floor((F.element_at("w", -1)["e"] - 1) / size)
    return blocks.withColumn("block", F.explode(F.sequence(F.col("block"), F.greatest("block", last))))
