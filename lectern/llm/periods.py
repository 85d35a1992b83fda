"""Periodic runs of words, by Lyndon roots.

A run is a stretch of consecutive words with smallest period q, of LEAST words or more and at least
2 * q long, that no neighbouring word extends.  Every run has a root that is the longest Lyndon
word at its place under one of two orders of the words, an order or its reverse.  So a text is
scanned from right to left under both, with a stack of the suffixes that are still smallest; the
top of the stack ends the longest Lyndon word that begins here.  Its length is the period to try:
it is extended to both sides, and counts if it holds twice.  Suffixes are compared, and roots
extended, by longest common extensions: the first words directly, then doubling and halving steps
over rolling hashes of the words; where these say that two stretches are equal, the words are compared.
There is no suffix array.

What cannot be in a run is not scanned.  A run of LEAST words or more is covered by stretches of
SHINGLE = LEAST / 2 words that occur in it twice, so a text is cut to the stretches covered by
such repeats, each of these again by its own repeats, until nothing falls away: text that
merely says something twice is settled there, and a run always lies whole in what remains.

A text is one row and its scan one piece of work in one task; nothing is shuffled.  Memory is a few
numbers a word of one text.

Cases: a null, empty or blank text has no words and no runs; rows are answered one by one, so repeated
rows and ids are each given their answer; an empty table gives no rows; other columns are not read.
A row without an id is answered with a null id (``planted`` leaves it as it is).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import session, table

LEAST = 12
SHINGLE = LEAST // 2
#: Words compared one by one before hashes are looked at.
FIRST = 8
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687 % _PRIME


def numbered(words: list[bytes]) -> list[int]:
    """A number for each word, the same for equal words."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def repeated_stretches(ids) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of ``ids`` covered by SHINGLE words that occur in the same stretch twice, LEAST long at least."""
    import numpy as np

    done, work = [], [(0, len(ids))]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    held = np.zeros(max(len(ids) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        held = held * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + len(held)]
    while work:
        a, b = work.pop()
        if b - a < LEAST:
            continue
        own = held[a : b - SHINGLE + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if not same.any():
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(twice)
        edge[at] += 1
        edge[at + SHINGLE] -= 1
        flips = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])))
        parts = [(a + int(x), a + int(y)) for x, y in zip(flips[::2], flips[1::2], strict=True)]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            work += parts
    return sorted(done)


class Extensions:
    """Longest common extensions to the right and to the left of two places in ``ids``."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.sums, self.powers = [0], [1]
        total, power = 0, 1
        for x in ids:
            total = (total * _BASE + x + 1) % _PRIME
            power = power * _BASE % _PRIME
            self.sums.append(total)
            self.powers.append(power)

    def _equal(self, i: int, j: int, size: int) -> bool:
        s, p = self.sums, self.powers[size]
        return not (s[i + size] - s[i] * p - s[j + size] + s[j] * p) % _PRIME

    def _search(self, room: int, equal: Callable[[int, int], bool]) -> int:
        """The most words, up to ``room``, that are equal from the place on; ``equal(done, size)`` tells of the next ``size``."""
        done, size = 0, FIRST
        while done + size <= room and equal(done, size):
            done += size
            size *= 2
        while size > 1:
            size //= 2
            if done + size <= room and equal(done, size):
                done += size
        return done

    def right(self, i: int, j: int) -> int:
        """Words equal from i and from j > i on."""
        ids, room = self.ids, self.n - j
        first = min(room, FIRST)
        for k in range(first):
            if ids[i + k] != ids[j + k]:
                return k
        if first == room:
            return room
        found = first + self._search(room - first, lambda done, size: self._equal(i + first + done, j + first + done, size))
        return found if ids[i : i + found] == ids[j : j + found] else self._plain(i, j, room)

    def _plain(self, i: int, j: int, room: int) -> int:
        return next((k for k in range(room) if self.ids[i + k] != self.ids[j + k]), room)

    def left(self, i: int, j: int) -> int:
        """Words equal up to and with i and j > i."""
        ids, room = self.ids, i + 1
        first = min(room, FIRST)
        for k in range(first):
            if ids[i - k] != ids[j - k]:
                return k
        if first == room:
            return room
        found = first + self._search(room - first, lambda done, size: self._equal(i + 1 - first - done - size, j + 1 - first - done - size, size))
        if ids[i + 1 - found : i + 1] == ids[j + 1 - found : j + 1]:
            return found
        return next((k for k in range(room) if ids[i - k] != ids[j - k]), room)


def scanned(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``ids``, in order of start and period."""
    n, common, found = len(ids), Extensions(ids), {}
    for sign in (1, -1):
        stack = [n]
        known: dict[int, tuple[int, int]] = {}  # of a period, the ends of the run lately found
        for i in range(n - 1, -1, -1):
            word = ids[i]
            while (top := stack[-1]) < n:
                other, k = ids[top], 0
                if other == word:
                    begin, end = known.get(top - i, (n, n))
                    k = end - top if begin <= i and top < end else common.right(i, top)
                    if top + k == n:
                        break  # the later suffix ends first and is the smaller one
                    other, mine = ids[top + k], ids[i + k]
                else:
                    mine = word
                if (mine - other) * sign > 0:
                    break
                stack.pop()
            stack.append(i)
            period = top - i
            if 2 * period > n:
                continue
            if known.get(period, (n, n))[0] <= i:
                continue  # inside the run of this period that was found before
            after = common.right(i, top) if top < n and ids[top] == word else 0
            before = common.left(i - 1, top - 1) if i and ids[i - 1] == ids[top - 1] else 0
            length = before + period + after
            if length >= 2 * period:
                known[period] = i - before, i - before + length
                if length >= LEAST:
                    found[i - before, period] = length
    return [(start, length, period) for (start, period), length in sorted(found.items())]


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words."""
    import numpy as np

    if len(words) < LEAST:
        return []
    ids = numbered(words)
    held = np.array(ids, np.int64)
    return [(a + s, length, q) for a, b in repeated_stretches(held) for s, length, q in scanned(ids[a:b])]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run after its first period."""
    import numpy as np

    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, kept) of every row; ``kept`` are the
    words outside repetitions, joined by blanks (their lower-case SHA-256 with ``with_text`` false).

    ``change`` may alter a row's words before they are looked at.
    """
    session(docs)

    def run(batches):
        import hashlib

        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            sizes, all_runs, kept = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                words = change(doc, words) if change else words
                found = runs(words)
                joined = b" ".join(collapsed(words, found))
                sizes.append(len(words))
                all_runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                kept.append(joined.decode() if with_text else hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(all_runs, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: those whose checksum ends in 0 repeat a stretch of words from some word on to their end."""
    import zlib

    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic(table(spark, sf_dir, "documents"), planted, with_text=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.col("kept").alias("collapsed_sha256"), "n_words")
    start, length, period = -F.col("b.before"), F.col("b.length"), -F.col("b.shorter")
    exact = F.expr("(1000 * b.length) div (- b.shorter)")
    return longest.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
