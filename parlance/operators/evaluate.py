"""Word error rate: alignment of token lists, weighted roll-up, percentiles of speed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAKDOWN = "reference_words int, hypothesis_words int, substitutions int, deletions int, insertions int"


def align(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a least-cost alignment.

    Of equal costs a match or substitution goes before a deletion, and that before an insertion.  Rows of the cost
    table are numpy arrays: insertions are a running minimum of cost minus place, whose last source counts.
    """
    number: dict[str, int] = {}
    r, h = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (ref, hyp))
    at = np.arange(len(h) + 1)
    cost, subs, dels, ins = at.copy(), np.zeros_like(at), np.zeros_like(at), at.copy()
    for i, w in enumerate(r.tolist(), 1):
        new = cost + 1
        wrong = (h != w).astype(np.int64)
        straight = cost[:-1] + wrong
        take = straight <= new[1:]
        new[1:] = np.where(take, straight, new[1:])
        s, d, n = subs.copy(), dels + 1, ins.copy()
        s[1:] = np.where(take, subs[:-1] + wrong, s[1:])
        d[1:] = np.where(take, dels[:-1], d[1:])
        n[1:] = np.where(take, ins[:-1], n[1:])
        lead = new - at
        source = np.maximum.accumulate(np.where(lead == np.minimum.accumulate(lead), at, 0))
        cost, subs, dels, ins = new[source] + at - source, s[source], d[source], n[source] + at - source
    return int(subs[-1]), int(dels[-1]), int(ins[-1])


#: Cells of the rows of cost tables that are worked on at once, and the words of a text from which on its pair is aligned by itself.
CELLS, LONG = 1 << 15, 1 << 15
#: A cell of ``align_all`` is one number: cost, place (17 bits) and deletions (16 bits).  Row and column tell the insertions, and these the substitutions.
_COST, _PLACE = 33, 16
_NO_PLACE = ~(((1 << (_COST - _PLACE)) - 1) << _PLACE)


def align_all(pairs: list[tuple]) -> list[tuple[int, int, int]]:
    """``align`` of each pair, by row i of the cost tables of many pairs of like length at once.

    A place is set in the deletion's candidate, so that a match or substitution of the same cost is the smaller number,
    and counts down within a row, so that the last of equal sources of an insertion is.
    """
    out: list = [None] * len(pairs)
    number: dict[str, int] = {}
    coded = []
    for i, (ref, hyp) in enumerate(pairs):
        if max(len(ref), len(hyp)) >= LONG:
            out[i] = align(list(ref), list(hyp))
        else:
            coded.append((len(ref), len(hyp), i))
    coded.sort()
    while coded:
        # At least one pair; the longest hypothesis sets the width.
        wide, take = 0, 0
        while take < len(coded) and (not take or (take + 1) * (max(wide, coded[take][1]) + 1) <= CELLS):
            wide = max(wide, coded[take][1])
            take += 1
        some, coded = coded[:take], coded[take:]
        n, m = (np.array([x[j] for x in some], np.int64) for j in (0, 1))
        r, h = np.full((n.max(), take), -1, np.int64), np.full((take, wide), -2, np.int64)
        for k, (a, b, i) in enumerate(some):
            ref, hyp = pairs[i]
            r[:a, k] = [number.setdefault(w, len(number)) for w in ref]
            h[k, :b] = [number.setdefault(w, len(number)) for w in hyp]
        at = np.arange(wide + 1)
        inserted = at << _COST
        lead = ((wide - at) << _PLACE) - inserted
        cell = np.tile(inserted, (take, 1))
        last = np.zeros(take, np.int64)
        for i in range(n.max() + 1):
            done = np.searchsorted(n, i, side="right")  # pairs are in order of n
            begin = np.searchsorted(n, i)
            last[begin:done] = cell[np.arange(begin, done) - (take - len(cell)), m[begin:done]]
            if done == take:
                break
            cell = cell[done - (take - len(cell)) :]
            new = cell + ((1 << _COST) + (1 << _PLACE) + 1)
            np.minimum(new[:, 1:], cell[:, :-1] + ((h[done:] != r[i, done:, None]).astype(np.int64) << _COST), out=new[:, 1:])
            new &= _NO_PLACE
            new += lead
            np.minimum.accumulate(new, axis=1, out=new)
            new &= _NO_PLACE
            new += inserted
            cell = new
        cost, dels = last >> _COST, last & ((1 << _PLACE) - 1)
        ins = dels + m - n
        for k, (_, _, i) in enumerate(some):
            out[i] = (int(cost[k] - dels[k] - ins[k]), int(dels[k]), int(ins[k]))
    return out


def error_counts(ref: Column, hyp: Column) -> Column:
    """The breakdown of two arrays of words, as a struct."""

    @F.pandas_udf(BREAKDOWN)
    def counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = [(len(r), len(h), *e) for r, h, e in zip(ref, hyp, align_all(list(zip(ref, hyp))))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in BREAKDOWN.split(", ")])

    return counts(ref, hyp)


def error_rate(ref_words: Column, errors: Column) -> Column:
    return F.when(ref_words > 0, errors / ref_words).when(errors > 0, 1.0).otherwise(0.0)


def rolled_up(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums of the parts first, the ratio last, so that long clips weigh more."""
    parts = [x.split()[0] for x in BREAKDOWN.split(", ")]
    g = counts.groupBy(*keys).agg(*(F.sum(p).alias(p) for p in parts))
    return g.withColumn("wer", error_rate(F.col("reference_words"), F.col("substitutions") + F.col("deletions") + F.col("insertions")))


#: Into how many ranges a key's values are dealt, from how many distinct values on (fewer are sorted at once), and to how many tasks each key's go.
RANGES, FEW, SALTS = 128, 10_000, 16


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], ranges: int = RANGES, few: int = FEW, times: str | None = None) -> DataFrame:
    """Percentiles sorted[round((n - 1) p)] without interpolation, null values left out; a null key is a key of its own.

    A row stands for as many values as its column ``times`` says, if one is named.

    Values are numbers, dates or times.  Equal values are counted first.  A key of more than ``few`` distinct values is cut
    into ranges at approximate quantiles of these; the ranges' exact counts tell which of them holds a rank, and no
    other is put in order.  So no task sorts more than about one part in ``ranges`` of a key, and exactness doesn't
    rest on where the cuts lie.  A key without values has no row, but a table without keys always has one.
    """
    each = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("_m"))
    inner = [i / ranges for i in range(1, ranges)]
    cuts = each.groupBy(*keys).agg(F.count("*").alias("_d"), F.percentile_approx(value, inner, 10 * ranges).alias("_cuts"))
    cuts = cuts.filter(F.col("_d") > few).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("_d")
    salted = each.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    dealt = _same(salted, cuts, [*keys, "_salt"], "left").drop("_salt")
    dealt = dealt.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col(value))), F.lit(-1))).drop("_cuts")
    # At most ``ranges`` rows a key from here.
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    counts = dealt.groupBy(*keys, "_range").agg(F.sum("_m").alias("_c"))
    counts = counts.select(*keys, "_range", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), F.sum("_c").over(upto).alias("_after"), F.sum("_c").over(whole).alias("_n"))
    rank = {name: F.floor((F.col("_n") - 1) * p + 0.5) for name, p in shares.items()}
    held = F.lit(False)
    for x in rank.values():
        held = held | ((F.col("_before") <= x) & (x < F.col("_after")))
    near = _same(dealt, counts.filter(held), [*keys, "_range"], "inner")
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_upto", F.col("_before") + F.sum("_m").over(inside))
    picks = (F.min(F.when((F.col("_before") <= x) & (x < F.col("_upto")), F.col(value))).alias(name) for name, x in rank.items())
    return near.groupBy(*keys).agg(*picks)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined on keys of which null equals null, with the left's keys."""
    named = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(named, both, how).drop(*(f"_same_{k}" for k in keys))


def real_time_factors(clips: DataFrame) -> DataFrame:
    """Adds rtf to (elapsed_seconds, audio_seconds); an empty clip counts as a millionth of a second."""
    return clips.withColumn("rtf", F.col("elapsed_seconds") / F.greatest(F.col("audio_seconds"), F.lit(1e-6)))


def report(clips: DataFrame) -> DataFrame:
    """One row for a benchmark: weighted error rate, sums of the parts and of seconds, median and 95th percentile of speed.

    ``clips`` has the breakdown of ``error_counts`` with audio_seconds and elapsed_seconds.
    """
    # Equal clips are counted first, and all that follows reads that one exchange, so that clips are aligned in fewer places of the plan (three; four before).
    parts = [p.split()[0] for p in BREAKDOWN.split(", ")]
    c = real_time_factors(clips).groupBy(*parts, "audio_seconds", "elapsed_seconds", "rtf").agg(F.count("*").alias("_clips"))
    times = lambda x: F.col(x) * F.col("_clips")
    total = lambda x: F.coalesce(F.sum(times(x)), F.lit(0.0)).alias(x)
    seconds = c.agg(F.coalesce(F.sum("_clips"), F.lit(0)).cast("long").alias("clips"), total("audio_seconds"), total("elapsed_seconds"))
    speed = nearest_rank(c, [], "rtf", {"rtf_p50": 0.5, "rtf_p95": 0.95}, times="_clips")
    speed = speed.select(*(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("rtf_p50", "rtf_p95")))
    return rolled_up(c.select(*(times(x).alias(x) for x in parts))).join(seconds, F.lit(True)).join(speed, F.lit(True))  # one row each


def passes(report: DataFrame, most: float = 0.25) -> bool:
    """Whether the error rate of a report is at most the gate's."""
    if not 0 <= most <= 1:
        raise ValueError("the highest rate must be in [0, 1]")
    return report.first()["wer"] <= most
