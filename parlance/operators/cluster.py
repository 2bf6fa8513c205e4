"""Speaker clustering: online by threshold with a merge pass, and offline refinement of a session.

Both are ordered folds over one session's embeddings; sessions are spread over tasks.
The fold keeps single precision, as borderline similarities decide by it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = np.finfo(np.float32).eps


@dataclass(frozen=True)
class OnlineConfig:
    threshold: float = 0.55
    most_speakers: int = 6
    merge: float = 0.70
    history: int = 10
    sticky: float = 0.05


#: For embeddings whose speakers are closer to each other; speakers aren't merged.
STRICT = OnlineConfig(threshold=0.78, merge=1.0)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.dot(v, v))
    return (v / n).astype(np.float32) if n > 0 else v


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = float(np.dot(a, a)), float(np.dot(b, b))
    return 0.0 if na <= EPSILON or nb <= EPSILON else float(np.dot(a, b) / np.sqrt(np.float32(na * nb)))


@dataclass
class OnlineClusters:
    """Slots count up and are never used again.

    A vector gets the slot it was assigned to, even if that slot is merged into another at once; ``merged`` lists
    (absorbed, survivor) in order, and ``survivors`` of it tells who answers for a slot in the end.
    """

    config: OnlineConfig = field(default_factory=OnlineConfig)
    slots: list[int] = field(default_factory=list)
    centroids: list[np.ndarray] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    merged: list[tuple[int, int]] = field(default_factory=list)
    last: int | None = None
    next_slot: int = 0

    def assign(self, vector) -> int:
        v = unit(np.asarray(vector, np.float32))
        best, sim = -1, -np.inf
        for i, c in enumerate(self.centroids):
            s = similarity(c, v) + (self.config.sticky if self.slots[i] == self.last else 0.0)
            if s > sim:
                best, sim = i, s
        if best >= 0 and (sim >= self.config.threshold or len(self.slots) >= self.config.most_speakers):
            n = min(self.counts[best], self.config.history)
            self.centroids[best] = unit((self.centroids[best] * np.float32(n) + v) / np.float32(n + 1))
            self.counts[best] += 1
        else:
            best = len(self.slots)
            self.slots.append(self.next_slot)
            self.next_slot += 1
            self.centroids.append(v)
            self.counts.append(1)
        slot = self.last = self.slots[best]
        self._merge_all()
        return slot

    def _merge_all(self) -> None:
        """Merges the two most similar speakers until none are similar enough; of equal counts the earlier one stays."""
        while self.config.merge < 1.0 and len(self.slots) > 1:
            n = len(self.slots)
            near = np.full((n, n), -np.inf)
            for i, j in zip(*np.triu_indices(n, 1)):
                near[i, j] = similarity(self.centroids[i], self.centroids[j])
            keep, gone = np.unravel_index(int(near.argmax()), near.shape)
            if near[keep, gone] < self.config.merge:
                break
            if self.counts[gone] > self.counts[keep]:
                keep, gone = gone, keep
            weights = np.float32(self.counts[keep]), np.float32(self.counts[gone])
            self.centroids[keep] = unit((self.centroids[keep] * weights[0] + self.centroids[gone] * weights[1]) / sum(weights))
            self.counts[keep] += self.counts[gone]
            self.merged.append((self.slots[gone], self.slots[keep]))
            self.last = self.slots[keep] if self.last == self.slots[gone] else self.last
            self.slots, self.centroids, self.counts = ([x for i, x in enumerate(xs) if i != gone] for xs in (self.slots, self.centroids, self.counts))


def online_speakers(vectors: DataFrame, session: str, seq: str, vector: str, config: OnlineConfig = OnlineConfig()) -> DataFrame:
    """(session, seq, slot): the speaker of each embedding when it arrived."""

    def fold(batches):
        import pyarrow as pa

        clusters = at = None
        for batch in batches:
            keys, rows = (batch.column(i).to_pylist() for i in (0, 1))
            ends, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            slots = []
            for i, key in enumerate(keys):
                if clusters is None or key != at:
                    clusters, at = OnlineClusters(config), key
                v = values[ends[i] : ends[i + 1]]
                slots.append(clusters.assign(v) if len(v) else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(slots, pa.int32())], ["session", "seq", "slot"])

    # A session's rows come in order to one task, which holds only its clusters and a batch.
    rows = vectors.select(session, seq, vector).repartition(session).sortWithinPartitions(session, F.col(seq).asc_nulls_last())
    return rows.mapInArrow(fold, "session long, seq long, slot int")


SPEAKERS = "session long, seq long, slot int, into int"
SPEAKER_STATE = "slots string, centroids binary, counts string, last int, next_slot int, seq long"


def speaker_stream(vectors: DataFrame, session: str, seq: str, vector: str, config: OnlineConfig = OnlineConfig(), forget_ms: int | None = None) -> DataFrame:
    """Rows (session, seq, slot, into) over a stream: the speaker of each embedding when it arrived, and, with ``into``, that
    a speaker was merged into another by the embedding seq.

    State is a session's centroids, of which there are at most ``most_speakers``; merges are told, not kept, and ``settled``
    applies them to what has been assigned before.  Embeddings of a session come in order of seq, but for those within a
    micro-batch; repeated ones are told by their seq.  With ``forget_ms`` a session goes after so long without one.
    """

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        clusters, at = OnlineClusters(config), None
        if state.exists:
            slots, centroids, counts, clusters.last, clusters.next_slot, at = state.get
            clusters.slots, clusters.counts = json.loads(slots), json.loads(counts)
            clusters.centroids = list(np.frombuffer(bytes(centroids), np.float32).reshape(len(clusters.slots), -1)) if clusters.slots else []
        rows = []
        for n, v in pd.concat(list(batches)).sort_values("seq")[["seq", "vector"]].itertuples(index=False):
            if (at is not None and n <= at) or v is None or not len(v):
                continue
            slot = clusters.assign(v)
            rows.append((key[0], n, slot, None))
            rows += [(key[0], n, gone, keep) for gone, keep in clusters.merged]
            clusters.merged, at = [], n
        if at is not None:
            centroids = np.concatenate(clusters.centroids).astype(np.float32).tobytes() if clusters.centroids else b""
            state.update((json.dumps(clusters.slots), centroids, json.dumps(clusters.counts), clusters.last, clusters.next_slot, int(at)))
            if forget_ms:
                state.setTimeoutDuration(forget_ms)
        if rows:
            pdf = pd.DataFrame(rows, columns=["session", "seq", "slot", "into"])
            yield pdf.astype({"slot": "Int32", "into": "Int32"})

    rows = vectors.select(F.col(session).cast("long").alias("session"), F.col(seq).cast("long").alias("seq"), F.col(vector).cast("array<float>").alias("vector"))
    return rows.groupBy("session").applyInPandasWithState(fold, SPEAKERS, SPEAKER_STATE, "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")


def settled(rows: DataFrame) -> DataFrame:
    """(session, seq, slot, speaker): what a stream has assigned, with the speaker who answers for the slot in the end."""
    merged = F.transform(F.array_sort(F.collect_list(F.struct("seq", "place", "slot", "into"))), lambda m: F.struct(m["slot"].alias("gone"), m["into"].alias("keep")))
    log = rows.filter("into IS NOT NULL").withColumn("place", F.monotonically_increasing_id()).groupBy("session").agg(merged.alias("log"))
    ends = F.aggregate("log", F.col("slot"), lambda slot, m: F.when(m["gone"] == slot, m["keep"]).otherwise(slot))
    out = rows.filter("into IS NULL").join(log, "session", "left")
    return out.select("session", "seq", "slot", F.when(F.col("log").isNull(), F.col("slot")).otherwise(ends).alias("speaker"))


def refine(slots, vectors, threshold: float = 0.75, least: int = 2) -> list[tuple[int, int]]:
    """(absorbed, survivor) in the order of merging the mean vectors of over-split speakers."""
    groups: dict[int, list] = {}
    for s, v in zip(slots, vectors):
        groups.setdefault(s, []).append(np.asarray(v, np.float64))
    kept = sorted(s for s, v in groups.items() if len(v) >= least)
    mean = {s: np.mean(groups[s], axis=0) for s in kept}
    mean = {s: v / (np.linalg.norm(v) or 1.0) for s, v in mean.items()}
    return merges({s: len(groups[s]) for s in kept}, mean, threshold)


def merges(n: dict[int, int], mean: dict[int, np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """The same by the counts and normalised means of the speakers that have enough vectors."""
    n, mean, kept, out = dict(n), dict(mean), sorted(n), []
    while len(kept) > 1:
        s, a, b = max(((float(mean[a] @ mean[b]), -a, -b) for i, a in enumerate(kept) for b in kept[i + 1 :]))
        if s < threshold:
            break
        a, b = -a, -b
        keep, gone = (a, b) if n[a] >= n[b] else (b, a)
        v = (mean[keep] * n[keep] + mean[gone] * n[gone]) / (n[keep] + n[gone])
        mean[keep] = v / (np.linalg.norm(v) or 1.0)
        n[keep] += n[gone]
        kept.remove(gone)
        out.append((gone, keep))
    return out


def survivors(merged: list[tuple[int, int]]) -> dict[int, int]:
    """Each absorbed speaker and the one it ends in."""
    out: dict[int, int] = {}
    for gone, keep in merged:
        out = {g: keep if k == gone else k for g, k in out.items()} | {gone: keep}
    return out


def refined_speakers(assigned: DataFrame, session: str, slot: str, vector: str, threshold: float = 0.75, least: int = 2) -> DataFrame:
    """``assigned`` with ``refined``, the speaker after merges."""
    # Counts and sums are combined place by place in Spark; only the means of a session's speakers go to one task.
    places = assigned.filter(F.col(slot).isNotNull()).select(session, slot, F.posexplode(vector).alias("place", "x"))
    places = places.groupBy(session, slot, "place").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("x"))
    means = places.groupBy(session, slot).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "x"))).alias("sums"))
    means = means.filter(F.col("n") >= least).select(F.col(session).alias("_session"), F.col(slot).alias("_slot"), "n", F.transform("sums", lambda p: p["x"] / F.col("n")).alias("mean"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = pdf["_slot"].tolist()
        mean = {s: v / (np.linalg.norm(v) or 1.0) for s, v in zip(slots, pdf["mean"])}
        found = survivors(merges(dict(zip(slots, pdf["n"].tolist())), mean, threshold))
        return pd.DataFrame({"_session": pdf["_session"], "_slot": pdf["_slot"], "refined": [found.get(s, s) for s in slots]})

    kinds = {f.name: f.dataType.simpleString() for f in means.schema.fields}
    found = means.groupBy("_session").applyInPandas(fold, f"_session {kinds['_session']}, _slot {kinds['_slot']}, refined int")
    out = assigned.join(found, F.col(session).eqNullSafe(F.col("_session")) & (F.col(slot) == F.col("_slot")), "left")
    return out.withColumn("refined", F.coalesce("refined", F.col(slot).cast("int"))).drop("_session", "_slot")
