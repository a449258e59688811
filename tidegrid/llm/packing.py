"""Mixture-controlled packing: deficit round-robin over source queues, carried across windows and partitions.

A document's ids (with an end id) join the queue of its source. A round fills one window: every queue's deficit grows by its
quantum, `window` ids times its share, the whole ids of the deficit are served and the rest is carried into the next
round. After r rounds a queue has served floor(r * upper) - floor(r * lower) ids, lower and upper being its place in the sum of all
quanta: within one id of r quanta for every queue and round, and together exactly r windows. So the piece of a queue that a window holds is known from
positions alone, by prefix sums of token counts; no state passes from window to window or partition to partition,
every window is full but the very last one, and documents are cut where the quantum ends.

Shares are the queues' own part of all ids unless `targets` names others, as parts of 1; queues without a target share what
the targets leave, in proportion to their ids, and if nothing is left the targets must name every source. A queue that is used
up drops out and the others' shares grow in proportion: the plan has a phase for each such event. A window cannot hold less than one id of
a source: sources of less than `LEAST` ids a window share one queue, in order of storage, so there are at most window / `LEAST` + 1
queues. A hot source is only a long queue: no task holds it.

Null source: a queue of its own. Null or empty text: only the end id. Texts of any length are encoded whole, one at a time.
Rows that share a key are packed as separate documents. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.llm.bpe import byte_characters
from tidegrid.llm.common import stash, text_of

#: Ids a window at least of a source that has a queue of its own.
LEAST = 2
#: How the null source is named among queues.
NO_SOURCE = "\0null"
_loaded: dict = {}


def byte_encoder(path: str):
    """Ids of a text under a byte-level BPE file. Its ranks are given to tiktoken, which is faster, if ids follow the
    order of merges; where that library gives up on a text, `tokenizers` encodes it."""
    if path not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        slow = Tokenizer.from_file(path)
        model, byte_of = spec["model"], {c: i for i, c in enumerate(byte_characters())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        found = [model["vocab"][a + b] for a, b in pairs]
        fast = None
        plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec["normalizer"]
        bare = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        if found == sorted(found) and plain and bare:
            ranks = {bytes(byte_of[c] for c in s): i for s, i in model["vocab"].items() if s not in added}
            #: fixed value: the split pattern of byte-level BPE
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

        def ids(text: str) -> np.ndarray:
            if fast is not None:
                try:
                    return np.array(fast.encode(text, allowed_special="all"), "<u4")
                except BaseException as e:  # its Rust code panics on some very long runs
                    if type(e).__name__ != "PanicException":
                        raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

        _loaded[path] = ids
    return _loaded[path]


def encoded(
    docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per document: (k, source, part, before, doc_tokens, ids binary). part: the task that encoded it; before: ids of the same
    source that this task met earlier. Ids take two bytes each where all of a document's do, else four (`wide`)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, source string, part bigint, before bigint, doc_tokens bigint, wide boolean, ids binary"

    def run(batches):
        encode = byte_encoder(path)
        part, met = TaskContext.get().partitionId(), {}
        for b in batches:
            for i in range(0, b.num_rows, 128):
                rows = b.slice(i, 128)
                before, size, wide, raw = [], [], [], []
                for t, s in zip(rows.column(2).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(t), np.uint32(end_id))
                    wide.append(bool(ids.max() > 0xFFFF))
                    raw.append(ids.astype("<u4" if wide[-1] else "<u2").tobytes())
                    size.append(len(ids))
                    before.append(met.get(s, 0))
                    met[s] = before[-1] + len(ids)
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([part] * n, pa.int64()), pa.array(before, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(wide, pa.bool_()), pa.array(raw, pa.binary())],
                    names=["k", "source", "part", "before", "doc_tokens", "wide", "ids"],
                )

    named = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
    return docs.select(F.col(key).alias("k"), named.alias("source"), text_of(text).alias("text")).mapInArrow(run, schema)


@dataclass
class Phase:
    """Rounds first .. first + rounds - 1 under the same shares. served: ids of each queue served before; upper: sums of quanta up to each
    queue. A phase of one round may hold whole ids instead, in which case upper is their running sum."""

    first: int
    rounds: int
    served: np.ndarray
    upper: np.ndarray

    def edges(self, r: np.ndarray) -> np.ndarray:
        """Ids of the stream that precede each queue's end, after r rounds of the phase: (rounds, queues + 1)."""
        ends = np.floor(np.asarray(r, np.float64)[:, None] * self.upper[None, :]).astype(np.int64)
        return np.concatenate([np.zeros((len(ends), 1), np.int64), ends], axis=1)

    def served_by(self, queue: int, r: np.ndarray) -> np.ndarray:
        """Ids of the queue served after r rounds of the phase."""
        r = np.asarray(r, np.float64)
        lower = np.floor(r * self.upper[queue - 1]) if queue else 0.0
        return self.served[queue] + (np.floor(r * self.upper[queue]) - lower).astype(np.int64)


def plan(sizes: np.ndarray, shares: np.ndarray, window: int) -> list[Phase]:
    """The phases that serve queues of `sizes` ids with the given shares (positive), in windows."""
    left, served, phases, first = sizes.astype(np.int64).copy(), np.zeros(len(sizes), np.int64), [], 0
    while left.any():
        quantum = np.where(left > 0, shares, 0.0)
        quantum = quantum * (window / quantum.sum())
        upper = np.cumsum(quantum)
        upper[np.flatnonzero(quantum)[-1] :] = window  # exactly, so that r rounds are r windows
        on = left > 0
        rounds = int(np.floor(((left[on] - 1) / quantum[on]).min())) - 1
        if rounds < 1:
            # one window: whole quanta while they last, what is missing from the queues that have more, by share
            rounds, give = 1, np.minimum(left, np.floor(quantum).astype(np.int64))
            want = min(window, int(left.sum()))
            while (lack := want - int(give.sum())) > 0:
                room = left - give
                weight = np.where(room > 0, quantum, 0.0)
                more = np.minimum(room, np.floor(lack * weight / weight.sum()).astype(np.int64))
                if not more.any():
                    more[np.argmax(np.where(room > 0, quantum, -1.0))] = 1
                give += more
            upper = np.cumsum(give).astype(np.float64)
        phase = Phase(first, rounds, served.copy(), upper)
        phases.append(phase)
        now = np.array([phase.served_by(q, np.array([rounds]))[0] for q in range(len(sizes))])
        left, served, first = left - (now - served), now, first + rounds
    return phases


def place(phases: list[Phase], queue: int, start: int, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset in it, length) of the pieces into which ids start .. start + n of a queue are cut."""
    seq, off, size = [], [], []
    at, end = start, start + n
    firsts = [int(p.served[queue]) for p in phases]
    i = max(np.searchsorted(firsts, at, side="right") - 1, 0)
    while at < end:
        p = phases[i]
        i += 1
        top = int(p.served_by(queue, np.array([p.rounds]))[0])
        if top <= at:
            continue
        stop, quantum = min(end, top), p.upper[queue] - (p.upper[queue - 1] if queue else 0.0)
        low = max(int((at - firsts[i - 1]) / quantum) - 2, 0)
        high = min(int((stop - firsts[i - 1]) / quantum) + 3, p.rounds)
        r = np.arange(low, high + 1)
        edges = p.served_by(queue, r)
        begin, finish = np.maximum(edges[:-1], at), np.minimum(edges[1:], stop)
        some = np.flatnonzero(finish > begin)
        before = np.floor(r[some] * p.upper[queue - 1]) - 0 if queue else np.zeros(len(some))
        after = np.floor((r[some] + 1) * p.upper[queue - 1]) if queue else np.zeros(len(some))
        seq.append(p.first + r[some])
        off.append((after - before).astype(np.int64) + begin[some] - edges[some])
        size.append((finish - begin)[some])
        at = stop
    return np.concatenate(seq), np.concatenate(off), np.concatenate(size)


def _shares(rows: list[tuple[str, int]], targets: dict[str | None, float] | None) -> dict[str, float]:
    """The share of each source."""
    total = sum(n for _, n in rows)
    if not targets:
        return {s: n / total for s, n in rows}
    named = {NO_SOURCE if s is None else s: float(t) for s, t in targets.items()}
    others = {s: n for s, n in rows if s not in named}
    rest = 1.0 - sum(named.values())
    if min(named.values()) <= 0 or rest < -1e-9 or (others and rest <= 1e-9):
        raise ValueError(f"targets must be positive parts of 1 and leave some of it to the sources without one, of which there are {len(others)}")
    return {s: named[s] if s in named else rest * n / sum(others.values()) for s, n in rows}


def queues(sums: DataFrame, window: int, targets: dict | None) -> tuple[dict[str, int], list[Phase]]:
    """(queue of each source that has its own, phases). The last queue is the one of all other sources. `sums`: (source, part, ids)."""
    by_source = sums.groupBy("source").agg(F.sum("ids").alias("n"))
    all_ids = by_source.agg(F.sum("n")).first()[0]
    if all_ids is None:
        return {}, []
    # with natural shares, or a target, only so many sources can reach the least; the others are never collected
    large = F.col("n") * F.lit(window / LEAST) >= F.lit(float(all_ids))
    if targets:
        large = large | F.col("source").isin([NO_SOURCE if s is None else s for s in targets])
    rows = sorted((r["source"], r["n"]) for r in by_source.filter(large).collect())
    small = int(all_ids - sum(n for _, n in rows))
    share = _shares([*rows, ("\0small", small)] if small else rows, targets)
    own = [s for s, _ in rows if share[s] * window >= LEAST]
    pool_share = sum(share.values()) - sum(share[s] for s in own)
    while own and len(own) < len(share) and pool_share * window < LEAST:
        least = min(own, key=lambda s: (share[s], s))
        own.remove(least)
        pool_share += share[least]
    size = dict(rows)
    sizes, shares = [size[s] for s in own], [share[s] for s in own]
    if len(own) < len(share):
        sizes, shares = [*sizes, all_ids - sum(sizes)], [*shares, pool_share]
    return {s: i for i, s in enumerate(own)}, plan(np.array(sizes, np.int64), np.array(shares), window)


def schedule(parts: DataFrame, window: int = 1024, targets: dict | None = None, digests: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32 or ids, doc_tokens, sequence_id, offset, source, round) of every piece.

    `parts`: the rows of `encoded`, as a written table. round: sequence_id + 1.
    """
    sums = stash(parts.groupBy("source", "part").agg(F.sum("doc_tokens").alias("ids")), "packing-sums")
    own, phases = queues(sums, window, targets)
    pool = len(own)
    # where in its queue the ids of a source and task begin: by tasks, and by sources within a task
    mapped = F.create_map(*[F.lit(x) for s, q in own.items() for x in (s, q)])[F.col("source")] if own else F.lit(None).cast("int")
    sums = sums.withColumn("queue", F.coalesce(mapped, F.lit(pool)))
    exclusive = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = sums.groupBy("queue", "part").agg(F.sum("ids").alias("n"))
    tasks = tasks.select("queue", "part", F.coalesce(F.sum("n").over(exclusive(Window.partitionBy("queue").orderBy("part"))), F.lit(0)).alias("base"))
    within = F.sum("ids").over(exclusive(Window.partitionBy("queue", "part").orderBy("source")))
    starts = sums.withColumn("within", F.coalesce(within, F.lit(0))).join(tasks, ["queue", "part"])
    starts = stash(starts.select("source", "part", "queue", (F.col("base") + F.col("within")).alias("base")), "packing-starts")
    placed = parts.join(starts, ["source", "part"]).select("k", "source", "doc_tokens", "queue", (F.col("base") + F.col("before")).alias("at"), "wide", "ids")
    kind = parts.schema["k"].dataType.simpleString()
    payload = "ids_crc32 bigint" if digests else "ids binary"
    schema = f"k {kind}, start bigint, length bigint, {payload}, doc_tokens bigint, sequence_id bigint, offset bigint, source string, round bigint"

    def cut(batches):
        import zlib

        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = b.slice(i, 64)
                columns = [rows.column(c).to_pylist() for c in ("queue", "at", "doc_tokens", "wide", "ids")]
                which, start, length, data, seqs, offs = [], [], [], [], [], []
                for j, (queue, at, n, wide, raw) in enumerate(zip(*columns, strict=True)):
                    seq, off, size = place(phases, queue, at, n, window)
                    whole = raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    edges = np.concatenate(([0], np.cumsum(size)))
                    for a, z in zip(4 * edges[:-1], 4 * edges[1:], strict=True):
                        data.append(zlib.crc32(whole[a:z]) if digests else whole[a:z])
                    which.append(np.full(len(size), j))
                    start.append(edges[:-1])
                    length.append(size)
                    seqs.append(seq)
                    offs.append(off)
                take = pa.array(np.concatenate(which))
                seq = pa.array(np.concatenate(seqs), pa.int64())
                source = [None if s == NO_SOURCE else s for s in rows.column("source").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("k").take(take), pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(length), pa.int64()),
                     pa.array(data, pa.int64() if digests else pa.binary()), rows.column("doc_tokens").take(take), seq,
                     pa.array(np.concatenate(offs), pa.int64()), pa.array(source, pa.string()).take(take), pa.array(np.concatenate(seqs) + 1, pa.int64())],
                    names=["k", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset", "source", "round"],
                )

    return placed.mapInArrow(cut, schema).withColumnRenamed("k", key)


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, targets: dict | None = None, digests: bool = False, **names) -> DataFrame:
    """Pack whole documents; each row is a piece with its ids (binary, little-endian unsigned 32-bit), or with their CRC-32 as
    `ids_crc32` in place of them. `names`: key, text and source columns."""
    parts = stash(encoded(docs, path, end_id, **names), "packing-ids")
    return schedule(parts, window, targets, digests, names.get("key", "doc_id"))


def window_mixture(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """(sequence_id, ids, distance): the total-variation distance of every window's mixture from `targets` (source, share)."""
    have = pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n"))
    size = have.groupBy("sequence_id").agg(F.sum("n").alias("ids"))
    named = targets.select(F.col("source").alias("source_"), "share")
    each = have.join(size, "sequence_id").join(named, have.source.eqNullSafe(F.col("source_")), "left")
    excess = F.greatest(F.col("n") / F.col("ids") - F.coalesce("share", F.lit(0.0)), F.lit(0.0))
    return each.groupBy("sequence_id").agg(F.first("ids").alias("ids"), F.sum(excess).alias("distance"))
