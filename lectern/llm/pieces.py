"""SentencePiece encoding and decoding, with a max-plus parallel scan over giant documents.

The public model merges pairs; its result is the one sequence of pieces in which every adjacent
pair stands together (encoding the two pieces' text gives the two pieces).  That makes encoding
a best-path problem over states "last piece": steps between pieces that stand together weigh one
(a piece more), all others minus infinity.  With such weights one path has a finite weight, so the
maximum has one candidate and the scan is one of reachability; a model with scored pieces would
put its scores in place of the ones, and no such model is at hand.

A document of more than CHUNK characters is cut anywhere, also inside words.  A boundary's states
are the pieces that may lie across it.  Each chunk, by itself, is scanned as a whole and gives its
max-plus transfer matrix from the states at its left end to those at its right end.  Matrices are
multiplied associatively, FAN neighbours to one, level by level in separate tasks, until each
document has one; then its best entry and exit go down the levels, each group finds its members'
states, and every chunk traces its own path back.  No piece crosses from a letter to a word start,
so a word inside a chunk has a matrix of one entry; equal words are scanned once, and what a
chunk's words give is kept for the way back.

Texts of CHUNK characters or fewer have no boundary and are encoded by the library whole.

Cases: null is the empty text and has no pieces; a text without a word start is one word and
is scanned through; unknown characters become bytes; rows of one doc_id are encoded each; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import session, staged, table

MODEL, CHUNK, FAN = "piece_bpe_32k.model", 1 << 15, 64
SPACE = "▁"
#: Words (of at most SHORT characters) whose path a task remembers, and pairs of pieces.
REMEMBERED, SHORT, MOST_PAIRS = 100_000, 64, 1 << 18


class Codec:
    """The library on whole texts, and on parts of normalised ones."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            data = f.read()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only merge models with the identity normaliser and a dummy prefix are known")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec.add_dummy_prefix = False
        self.part = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        normal = [p.piece for p in model.pieces if p.type in (1, 4)]
        self.known, self.longest = set(normal), max(map(len, normal))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[list[int], int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.whole.encode(texts, num_threads=1)

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids of pieces given as strings; what is no piece becomes bytes."""
        out: list[int] = []
        for p in pieces:
            out.extend([self.part.piece_to_id(p)] if p in self.known else self.part.encode(p))
        return out

    def together(self, a: str, b: str) -> bool:
        """Whether the pieces a, b are the encoding of their joined text."""
        if a == "":
            return b not in self.known or self.part.encode_as_pieces(b) == [b]
        if a not in self.known or b not in self.known:
            return self.together("", b)
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > MOST_PAIRS:
                self._pairs.clear()
            found = self._pairs[a, b] = self.part.encode_as_pieces(a + b) == [a, b]
        return found

    def words(self, text: str) -> tuple[list[int], int]:
        """(ids, number of pieces) of a text that begins and ends at word starts, by the scan."""
        import re

        ids: list[int] = []
        weight = 0
        for word in re.findall(f"{SPACE}+[^{SPACE}]*", text):
            found = self._words.get(word)
            if found is None:
                path = self.word_path(word)
                found = (self.ids(path), len(path))
                if len(word) <= SHORT:
                    if len(self._words) >= REMEMBERED:
                        self._words.clear()
                    self._words[word] = found
            ids += found[0]
            weight += found[1]
        return ids, weight

    def word_path(self, word: str) -> list[str]:
        """The one path through a word: its states depth first, longer pieces first, none of them twice."""
        path: list[int] = [0]  # ends of the pieces so far
        left = [self.next_lengths(word, 0)]
        dead = set()
        while path[-1] < len(word):
            at, before = path[-1], word[path[-2] : path[-1]] if len(path) > 1 else ""
            while left[-1]:
                n = left[-1].pop()
                if (at, n) not in dead and self.together(before, word[at : at + n]):
                    path.append(at + n)
                    left.append(self.next_lengths(word, at + n))
                    break
            else:
                left.pop()
                end = path.pop()
                dead.add((path[-1], end - path[-1]))
        return [word[a:b] for a, b in zip(path, path[1:], strict=False)]

    def next_lengths(self, text: str, at: int) -> list[int]:
        """Lengths of the pieces that begin at ``at``; one character always is a step."""
        return [n for n in range(1, min(self.longest, len(text) - at) + 1) if n == 1 or text[at : at + n] in self.known]


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def word_start(text: str, low: int, high: int, last: bool = False) -> int | None:
    """First (or last) place in [low, high) where a word starts, which no piece crosses."""
    spots = range(high - 1, low - 1, -1) if last else range(low, high)
    return next((i for i in spots if text[i] == SPACE and i and text[i - 1] != SPACE), None)


def walk(codec: Codec, text: str, entries: dict[tuple[int, int], float], begin: int, stop: int, exact: bool) -> dict:
    """Best paths from entry pieces to ``stop``.

    A state is (begin, end) of a piece in ``text``; ``entries`` gives states and weights, and
    (begin, begin) stands for no piece before.  Returns {state: (weight, state before)}; exits are
    the states with begin < stop <= end, or end == stop if ``exact``.
    """
    best = {s: (w, None) for s, w in entries.items()}
    by_end: dict[int, list[tuple[int, int]]] = {}
    for s in entries:
        by_end.setdefault(s[1], []).append(s)
    for at in range(begin, stop):
        for state in by_end.pop(at, ()):
            weight, piece = best[state][0], text[state[0] : state[1]]
            for n in codec.next_lengths(text, at):
                after = (at, at + n)
                if (exact and at + n > stop) or not codec.together(piece, text[at : at + n]):
                    continue
                if after not in best:
                    by_end.setdefault(at + n, []).append(after)
                elif best[after][0] >= weight + 1:
                    continue
                best[after] = (weight + 1, state)
    return best


def path_to(best: dict, state: tuple[int, int]) -> list[tuple[int, int]]:
    """States after the entry, up to ``state``."""
    out = []
    while best[state][1] is not None:
        out.append(state)
        state = best[state][1]
    return out[::-1]


class Part:
    """One chunk: ``text`` holds it from ``left`` to ``right``, with context of a piece's length on both sides."""

    def __init__(self, codec: Codec, text: str, left: int, right: int, first: bool, final: bool):
        self.codec, self.text, self.left, self.right, self.first, self.final = codec, text, left, right, first, final
        low = left if first else min(left + codec.longest, right)
        self.head = left if first else word_start(text, low, right)
        self.tail = None if self.head is None else word_start(text, self.head, right, last=True)
        if self.tail is None and self.head is not None:
            self.tail = self.head

    def entries(self) -> list[tuple[int, int]]:
        """Pieces that may lie across the left end, or the place where the document begins."""
        if self.first:
            return [(self.left, self.left)]
        at = self.left
        return [(at - a, at - a + n) for a in range(1, min(self.codec.longest, at) + 1) for n in self.codec.next_lengths(self.text, at - a) if n >= a]

    def _parts(self, entry):
        """Best states to the first word start, or through the chunk if it has none."""
        if self.head is None:
            return walk(self.codec, self.text, {entry: 0.0}, entry[1], self.right, self.final)
        if self.first:
            return {entry: (0.0, None)}
        return walk(self.codec, self.text, {entry: 0.0}, entry[1], self.head, True)

    def _exits(self, best) -> list[tuple[int, int]]:
        return [s for s in best if s[1] == self.right or (not self.final and s[0] < self.right < s[1])]

    def _end(self):
        start = (self.tail, self.tail)
        return walk(self.codec, self.text, {start: 0.0}, self.tail, self.right, self.final)

    def middle(self) -> tuple[list[int], int]:
        """(ids, weight) between the first and the last word start, which all paths through the chunk share."""
        return self.codec.words(self.text[self.head : self.tail])

    def transfer(self, shared: int | None = None) -> list[tuple[int, int, int, int, float]]:
        """Finite entries of the matrix: (entry begin, end, exit begin, end, pieces), relative to the two ends; ``shared`` is the middle's weight if it is known."""
        out = []
        end = None
        if shared is None:
            shared = 0 if self.head is None else self.middle()[1]
        for entry in self.entries():
            best = self._parts(entry)
            if self.head is None:
                found = [(s, best[s][0]) for s in self._exits(best)]
                if entry[1] > self.right and not self.final:
                    found = [(entry, 0.0)]
            else:
                arrived = [best[s][0] for s in best if s[1] == self.head]
                if not arrived:
                    continue
                if end is None:
                    tail = self._end()
                    end = {s: tail[s][0] for s in self._exits(tail)}
                found = [(s, max(arrived) + shared + w) for s, w in end.items()]
            out.extend((entry[0] - self.left, entry[1] - self.left, s[0] - self.right, s[1] - self.right, w) for s, w in found)
        return out

    def trace(self, entry: tuple[int, int], exit_: tuple[int, int], middle: list[int] | None = None) -> list[int]:
        """Ids of the pieces after ``entry`` up to ``exit_``, both relative as in ``transfer``; ``middle`` if it is known."""
        entry = (entry[0] + self.left, entry[1] + self.left)
        exit_ = (exit_[0] + self.right, exit_[1] + self.right)
        spell = lambda states: self.codec.ids([self.text[a:b] for a, b in states])
        best = self._parts(entry)
        if self.head is None:
            return [] if exit_ == entry else spell(path_to(best, exit_))
        arrived = max((s for s in best if s[1] == self.head), key=lambda s: best[s][0])
        return [*spell(path_to(best, arrived)), *(self.middle()[0] if middle is None else middle), *spell(path_to(self._end(), exit_))]


def product(a: dict, b: dict) -> dict:
    """Max-plus product of sparse matrices {(row, column): weight}."""
    rows: dict = {}
    for (i, k), w in b.items():
        rows.setdefault(i, []).append((k, w))
    out: dict = {}
    for (i, j), w in a.items():
        for k, v in rows.get(j, ()):
            if w + v > out.get((i, k), float("-inf")):
                out[i, k] = w + v
    return out


def joined(matrices: list[dict]) -> dict:
    """Product of neighbouring matrices, as a balanced tree."""
    while len(matrices) > 1:
        pairs = [product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(matrices) // 2 * 2 :]
    return matrices[0]


def states(matrices: list[dict], entry, exit_) -> list[tuple]:
    """(entry, exit) of each of neighbouring matrices on the best path from ``entry`` to ``exit_``."""
    reach = [{entry: 0.0}]
    for m in matrices:
        after: dict = {}
        for (i, j), w in m.items():
            if i in reach[-1] and reach[-1][i] + w > after.get(j, float("-inf")):
                after[j] = reach[-1][i] + w
        reach.append(after)
    out = []
    for m, before in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        into = max((i for i, j in m if j == exit_ and i in before), key=lambda i: before[i] + m[i, exit_])
        out.append((into, exit_))
        exit_ = into
    return out[::-1]


def parts_of(text: str, chunk: int, longest: int) -> list[tuple[int, str, int, int, bool]]:
    """(number, text with context, left, right, final) of the chunks of a normalised text."""
    out = []
    for k, at in enumerate(range(0, len(text), chunk)):
        low, high = max(0, at - 2 * longest), min(len(text), at + chunk)
        out.append((k, text[low : high + 2 * longest], at - low, high - low, high == len(text)))
    return out


_CHUNKS = "row long, doc_id long, k int, part string, l int, r int, final boolean"
_MATRIX = "row long, k int, m array<struct<a:int,b:int,c:int,d:int,w:double>>"
_STATES = "row long, k int, a int, b int, c int, d int"


def _matrix(entries) -> dict:
    return {((e["a"], e["b"]), (e["c"], e["d"])): e["w"] for e in entries}


def _entries(matrix: dict) -> list[dict]:
    return [{"a": i[0], "b": i[1], "c": j[0], "d": j[1], "w": w} for (i, j), w in matrix.items()]


def _combined(pdf):
    """For applyInPandas by row and group: the product of the group's matrices."""
    import pandas as pd

    pdf = pdf.sort_values("k")
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "k": [pdf["g"].iloc[0]], "m": [_entries(joined([_matrix(m) for m in pdf["m"]]))]})


def _resolved(pdf):
    """For applyInPandas by row and group: the members' states, from the group's entry (a, b) and exit (c, d)."""
    import pandas as pd

    pdf = pdf.sort_values("k")
    first = pdf.iloc[0]
    found = [(*i, *j) for i, j in states([_matrix(m) for m in pdf["m"]], (first["a"], first["b"]), (first["c"], first["d"]))]
    return pd.DataFrame({"row": pdf["row"].to_numpy(), "k": pdf["k"].to_numpy(), **dict(zip("abcd", zip(*found, strict=True), strict=True))})


def _best(batches):
    """Entry and exit of the heaviest path through each document's matrix."""
    import pyarrow as pa

    for batch in batches:
        best = [max(m, key=lambda e: e["w"]) for m in batch.column("m").to_pylist()]
        cols = [pa.array([e[c] for e in best], pa.int32()) for c in "abcd"]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), *cols], ["row", "k", *"abcd"])


def scan(matrices: DataFrame, top: int, fan: int = FAN) -> DataFrame:
    """(row, k, a, b, c, d): the states of every chunk, from the chunks' matrices (row, k, m); ``top`` is the largest k."""
    levels = [matrices]
    while top > 0:
        grouped = levels[-1].withColumn("g", F.floor(F.col("k") / fan).cast("int"))
        levels.append(staged(grouped.groupBy("row", "g").applyInPandas(_combined, _MATRIX)))
        top //= fan
    on = levels.pop().mapInArrow(_best, _STATES)
    for level in reversed(levels):
        members = level.withColumn("g", F.floor(F.col("k") / fan).cast("int")).join(on.withColumnRenamed("k", "g"), ["row", "g"])
        on = members.groupBy("row", "g").applyInPandas(_resolved, _STATES)
    return on


def encoded(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, text, n_chunks, ids array<int>) of every row; ``row`` tells rows apart."""
    session(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk

    def whole(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            ids = codec.encode(batch.column("text").to_pylist()) if len(batch) else []
            arrays = [*[batch.column(n) for n in ("row", "doc_id", "text")], pa.array([1] * len(batch), pa.int32()), listed(ids)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "text", "n_chunks", "ids"])

    def split(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text")), strict=True):
                cols = list(zip(*((row, doc, *p) for p in parts_of(normalised(text), chunk, codec.longest)), strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "doc_id", "k", "part", "l", "r", "final"])

    def transfer(batches):
        import pyarrow as pa

        codec = Codec(path)
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in "abcd"] + [("w", pa.float64())]))
        for batch in batches:
            out, middles = [], []
            for k, part, left, right, final in zip(*(batch.column(n).to_pylist() for n in ("k", "part", "l", "r", "final")), strict=True):
                one = Part(codec, part, left, right, k == 0, final)
                middle = ([], 0) if one.head is None else one.middle()
                out.append([dict(zip("abcdw", e, strict=True)) for e in one.transfer(middle[1])])
                middles.append(middle[0])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(out, kind), listed(middles)], ["row", "k", "m", "middle"])

    def trace(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            ids = []
            for k, part, left, right, final, middle, *s in zip(*(batch.column(n).to_pylist() for n in ("k", "part", "l", "r", "final", "middle", *"abcd")), strict=True):
                ids.append(Part(codec, part, left, right, k == 0, final).trace((s[0], s[1]), (s[2], s[3]), middle))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("row", "doc_id", "k")], pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "k", "ids"])

    small = rows.where(~giant).mapInArrow(whole, "row long, doc_id long, text string, n_chunks int, ids array<int>")
    held = staged(rows.where(giant).repartition("row"))
    if held.isEmpty():
        return small
    chunks = staged(held.mapInArrow(split, _CHUNKS))
    dealt = chunks.repartition("row", "k")
    matrices = staged(dealt.mapInArrow(transfer, f"{_MATRIX}, middle array<int>"))
    on_path = scan(matrices.select("row", "k", "m"), matrices.agg(F.max("k")).first()[0] or 0)
    traced = chunks.join(matrices.select("row", "k", "middle"), ["row", "k"]).join(on_path, ["row", "k"]).mapInArrow(trace, "row long, doc_id long, k int, ids array<int>")
    whole_ids = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x"))
    large = held.join(whole_ids, "row").select("row", "doc_id", "text", F.size("x").alias("n_chunks"), F.flatten("x.ids").alias("ids"))
    return small.unionByName(large)


def listed(lists: list[list[int]]):
    """Arrow list<int32> array of Python lists."""
    from itertools import chain

    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, lists)])
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def id_lists(column) -> list[list[int]]:
    """Python lists of an Arrow list<int32> column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
    return [flat[i:j].tolist() for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with ids array<int>) and their ``decoded`` text."""

    def run(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            texts = codec.whole.decode(id_lists(batch.column("ids")), num_threads=1) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    session(rows)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, decoded string")


def digests(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, n_chunks, round_trip) of ``encoded`` rows: digest of the ids as little-endian 32-bit integers."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            lists = id_lists(batch.column("ids"))
            texts = codec.whole.decode(lists, num_threads=1) if lists else []
            same = [a == b for a, b in zip(texts, batch.column("text").to_pylist(), strict=True)]
            sha = [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in lists]
            arrays = [batch.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), pa.array(sha, pa.string()), batch.column("n_chunks"), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "n_chunks", "round_trip"])

    session(rows)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, n_chunks int, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    return digests(encoded(table(spark, sf_dir, "documents"), path), path)
