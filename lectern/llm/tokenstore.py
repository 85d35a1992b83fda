"""Content-addressed store of token ids.

Whole texts are encoded by the library, with any of its vocabularies (``Encoder``: runs of text that occur again are encoded once where the vocabulary's
own pre-tokeniser allows it); a rolling hash of the last WINDOW ids cuts each document's ids into chunks, and every distinct chunk is stored once under
the SHA-256 of its bytes.  Layout of a store:

* ``objects``: ``key`` (digest), ``ids`` (little-endian unsigned integers of ``width`` bytes).
* ``recipes``: in ascending doc_id order, one row a document: ``part``, ``doc_id``, ``row``,
  ``local`` (ids before it in its part), ``page`` (PAGE documents of a part each), ``n_tokens``,
  ``digests`` and ``sizes`` of its chunks, and ``root``, the root of the Merkle tree over the digests.
* ``manifest``: one row a part: ``width``, ``start``, ``n_docs``, ``n_tokens`` and ``root`` over its pages'
  roots, each of which is over its documents' roots.  No task holds more roots than a page has, or a part's pages.

Reading back verifies each object against its key and each recipe against its root and the part's
root; a mismatch or a missing chunk fails the job.  Checksums of documents are joined from
checksums of chunks, so that no ids are moved to check a whole store.

Cases: null is the empty text, whose ids are the end id alone; rows with the same doc_id are
documents of their own; a null doc_id comes first; an empty table makes an empty store; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import hot_join, release, session, shared_dir, staged, table

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
WINDOW, CUT_BITS, SHORTEST, LONGEST = 16, 9, 128, 4096
#: Documents in a page of a part: their roots make a tree, and the pages' roots make the part's.
PAGE = 1 << 16
#: Rows and bytes of an Arrow batch, and bytes given to the library at once.
BATCH, BATCH_BYTES, CALL_BYTES = 2000, 6 << 20, 1 << 20
#: Runs whose ids a worker keeps, the most characters of such a run, and of how many texts of a batch one is encoded whole for comparison.
KEPT, KEPT_CHARS, COMPARED = 400_000, 64, 256
#: Fixed value: the one pre-tokenisation for which cutting texts to runs is proved.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file has what ``Encoder`` needs to cut texts to runs."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    loose = [t for t in spec["added_tokens"] if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
    return plain and not loose and {k: pre.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL


class Encoder:
    """The tokenizers library on whole texts; runs that occur again are encoded once.

    ``runs_of`` cuts texts only where the byte-level pre-tokeniser always cuts, and the model sees
    each of its pieces apart, so a text's ids are those of its runs, one after the other.  Any
    other kind of tokenizer (``byte_level``) gets the texts as they are.  One text in COMPARED is
    encoded whole besides, and must have the same ids.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.runs_apart = byte_level(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def _calls(self, texts: list[str]):
        """Slices of ``texts`` of about CALL_BYTES, which bound what the library holds besides ids."""
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CALL_BYTES:
                yield texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield texts[at:]

    def encode(self, texts: list[str]) -> list:
        """An array of uint32 ids for each text."""
        import numpy as np

        return [np.array(e.ids, np.uint32) for part in self._calls(texts) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]

    def encode_flat(self, texts):
        """(ids of all texts as one uint32 array, number of ids of each) of an Arrow string array without nulls."""
        import numpy as np

        if not self.runs_apart:
            coded = texts.dictionary_encode()
            lists = self.encode(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy(zero_copy_only=False).tolist()
            ids = np.concatenate([np.array([], np.uint32), *[lists[i] for i in at]])
            return ids, np.array([len(lists[i]) for i in at], np.int64)
        runs, bounds = runs_of(texts, self.added)
        coded = runs.dictionary_encode()
        bodies = self._bodies(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, bodies), np.int32, len(bodies)) // 4
        at = coded.indices.to_numpy(zero_copy_only=False)
        n, begin = sizes[at], (np.cumsum(sizes, dtype=np.int32) - sizes)[at]
        ends = np.append(np.int32(0), np.cumsum(n, dtype=np.int32))  # ids are no more than bytes, whose offsets have 32 bits
        place = np.repeat(begin - ends[:-1], n)
        place += np.arange(len(place), dtype=np.int32)
        ids, ends = np.frombuffer(b"".join(bodies), np.uint32)[place], ends[bounds]
        for i, whole in zip(range(0, len(texts), COMPARED), self.encode(texts[::COMPARED].to_pylist()), strict=True):
            if not np.array_equal(ids[ends[i] : ends[i + 1]], whole):
                raise ValueError("the ids of a text are not those of its runs")
        return ids, np.diff(ends).astype(np.int64)

    def _bodies(self, runs: list[str]) -> list[bytes]:
        """The ids of each of different runs, as bytes of uint32; those of the first KEPT short ones are kept."""
        bodies = list(map(self.known.get, runs))
        missing = [i for i, b in enumerate(bodies) if b is None]
        new = [runs[i] for i in missing]
        lined = [len(self.line_end) == 1 and own_line(r) for r in new]
        in_lines = iter(self._lines([r for r, x in zip(new, lined, strict=True) if x]))
        alone = iter(self.encode([r for r, x in zip(new, lined, strict=True) if not x]))
        for i, r, x in zip(missing, new, lined, strict=True):
            bodies[i] = next(in_lines) if x else next(alone).tobytes()
            if len(self.known) < KEPT and len(r) <= KEPT_CHARS:
                self.known[r] = bodies[i]
        return bodies

    def _lines(self, runs: list[str]) -> list[bytes]:
        """The ids of runs for which ``own_line`` holds, as bytes: many to a text, a line end between them."""
        import numpy as np

        out = []
        for part in self._calls(runs):
            ids = self.encode(["\n".join(part)])[0]
            ends = np.append(np.flatnonzero(ids == self.line_end[0]), len(ids)) * 4
            body, at = ids.tobytes(), 0
            if len(ends) != len(part):
                raise ValueError("line ends are not pieces of their own")
            for end in ends.tolist():
                out.append(body[at:end])
                at = end + 4
        return out


def own_line(run: str) -> bool:
    """Whether a run keeps its pieces between two line ends, which are pieces of their own there: it has none, and no white space at its ends but a blank at its head."""
    rest = run[1:] if run[:1] == " " else run
    return rest != "" and rest == rest.strip(" \t\n\v\f\r") and "\n" not in rest and (rest.isascii() or rest == rest.strip().strip("\u180e"))


def runs_of(texts, added: list[str]):
    """(runs of an Arrow string array without nulls, in order; at which run each text begins, and the number of runs).

    A cut is made where no alternative of the byte-level pattern can match on both sides: between
    ASCII letters, digits and signs (the apostrophe, of contractions, is no sign here); before
    white space that stands alone between two characters that are none; and behind it, unless it is
    the blank, which goes with what follows.  The alternative that looks ahead looks past several
    white spaces, which are never cut.  If a text has an ``added`` token, only blanks are cut at.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low, high = int(starts[0]), int(starts[-1])
    # Three more bytes on both sides, line ends, so that every byte has neighbours.
    body = np.full(high - low + 6, 10, np.uint8)
    body[3:-3] = np.frombuffer(data or b"", np.uint8)[low:high]
    starts = starts - low + 3
    first = np.zeros(len(body) + 1, bool)
    first[starts] = True
    # White space of several bytes: all of it ends in 80 to 8F, 9F, A0, A8, A9 or AF after C2, 80, 81, 9A or A0, and begins with C2 or E1 to E3.
    blank, ends, before, begins = (np.isin(np.arange(256), [*x]) for x in ((*range(9, 14), *range(28, 33)), (*range(0x80, 0x90), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF), (0xC2, 0x80, 0x81, 0x9A, 0xA0), (0xC2, 0xE1, 0xE2, 0xE3)))
    at = np.flatnonzero((body == 32) | (body == 10))[3:-3]
    last, following = body[at - 1], body[at + 1]
    spaced = blank[last] | (ends[last] & before[body[at - 2]]) | blank[following] | begins[following]
    at = at[~(spaced | first[at] | first[at + 1])]
    cuts = [at[body[at] == 32]]
    if not any(pc.any(pc.match_substring(texts, t)).as_py() for t in added):
        line = at[body[at] == 10]
        kind = np.array([0 if chr(c) in "'" or not 32 < c < 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)[body]
        change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] * kind[:-1] > 0)) + 1
        cuts += [line, line + 1, change[~first[change]]]
    at = np.sort(np.concatenate(cuts))
    bounds = np.sort(np.concatenate([starts, at]).astype(np.int32), kind="stable")
    runs = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return runs, np.searchsorted(at, starts) + np.arange(len(starts))


def shared_encoder(path: str) -> Encoder:
    """One encoder a Python worker: the tasks it runs one after the other share it."""
    import sys

    held = sys.__dict__.setdefault("_lectern_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def gears(size: int):
    """Random-looking 32-bit values of the ids, by the finaliser of splitmix64."""
    import numpy as np

    x = np.arange(size, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def marks(ids, gear):
    """Places (ends) where the rolling hash of the WINDOW ids before calls for a cut."""
    import numpy as np

    h = gear[ids]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def cuts(places: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the document at [begin, end), from its ``marks``.

    As SHORTEST exceeds WINDOW, they depend on nothing but ids of the document.
    """
    ends, last = [], begin
    for at in places:
        while at - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if at - last >= SHORTEST:
            ends.append(at)
            last = at
    while end - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return ends if last == end else [*ends, end]


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and inner nodes are hashed apart, an odd node goes up as it is."""
    import hashlib

    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def zero_operators(count: int = 40):
    """Matrices over bits that append 2**k zero bytes to a CRC-32."""
    import numpy as np

    def square(m):
        return apply_operator(m, m)

    one_bit = np.array([0xEDB88320, *[1 << k for k in range(31)]], np.uint32)
    byte = square(square(square(one_bit)))
    out = [byte]
    for _ in range(count - 1):
        out.append(square(out[-1]))
    return out


def apply_operator(m, values):
    import numpy as np

    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), m[bit], np.uint32(0))
    return out


def advanced(crcs, zeros, operators):
    """CRC-32 values after ``zeros`` more zero bytes each; their exclusive or is the CRC of the whole."""
    import numpy as np

    out = crcs.astype(np.uint32)
    for k, m in enumerate(operators):
        rows = np.flatnonzero(zeros >> k & 1)
        if len(rows):
            out[rows] = apply_operator(m, out[rows])
    return out


_OBJECTS = "key binary, ids binary, doc_id long, row long, n_tokens long, digests array<binary>, sizes array<int>"
_RECIPES = "part int, doc_id long, row long, local long, page int, n_tokens long, digests array<binary>, sizes array<int>, root binary"


def _encoded(path: str, end_id: int):
    def run(batches):
        import hashlib
        import struct

        import numpy as np
        import pyarrow as pa

        encoder, seen = shared_encoder(path), set()
        gear = gears(max(end_id + 1, encoder.library.get_vocab_size()))
        kind = "<u2" if encoder.width == 2 else "<u4"
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        names = ["key", "ids", "doc_id", "row", "n_tokens", "digests", "sizes"]
        for batch in batches:
            rows = []
            ids, counts = encoder.encode_flat(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            stops = np.cumsum(counts)
            places = marks(ids, gear)
            within = np.searchsorted(places, np.append(0, stops), side="right").tolist()
            places, body = places.tolist(), ids.astype(kind).tobytes()
            for i, (doc, row, n, stop) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), counts.tolist(), stops.tolist(), strict=True)):
                last, digests, sizes = stop - n, [], []
                for at in cuts(places[within[i] : within[i + 1]], last, stop):
                    part = body[last * encoder.width : at * encoder.width]
                    key = hashlib.sha256(part).digest()
                    if key not in seen:
                        seen.add(key)
                        rows.append((key, part, None, None, None, None, None))
                    digests.append(key)
                    sizes.append(at - last)
                    last = at
                rows.append((b"recipe" + struct.pack("<q", row), None, doc, row, n, digests, sizes))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _numbered(batches):
    """Running count of ids inside a part, the page, and the root of each recipe."""
    import pyarrow as pa

    total = seen = 0
    for batch in batches:
        local = []
        for n in batch.column("n_tokens").to_pylist():
            local.append(total)
            total += n
        roots = [merkle(d) for d in batch.column("digests").to_pylist()]
        pages = [i // PAGE for i in range(seen, seen + len(local))]
        seen += len(local)
        cols = {n: batch.column(n) for n in ("part", "doc_id", "row", "n_tokens", "digests", "sizes")}
        cols |= {"local": pa.array(local, pa.int64()), "page": pa.array(pages, pa.int32()), "root": pa.array(roots, pa.binary())}
        names = [f.split()[0] for f in _RECIPES.split(", ")]
        yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)


def _tree(keys: list[str], order: str):
    """For applyInPandas: ``keys`` and the root over a group's roots, in order."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "root": [merkle(list(pdf["root"]))]})

    return run


def write_store(docs: DataFrame, root: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` with the vocabulary file at ``path`` and write a store under ``root``."""
    spark = session(docs, BATCH, BATCH_BYTES)
    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = picked.mapInArrow(_encoded(path, end_id), _OBJECTS)
    objects = staged(rows.repartition("key").dropDuplicates(["key"]), f"{root}/objects")
    release(spark)
    recipes = objects.where("row is not null").select("doc_id", "row", "n_tokens", "digests", "sizes")
    ordered = recipes.repartitionByRange(F.col("doc_id"), F.col("row")).sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    written = staged(ordered.mapInArrow(_numbered, _RECIPES), f"{root}/recipes")
    totals = written.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    roots = _rooted(written)
    start, rows_, width = 0, [], Encoder(path).width
    for r in totals.join(roots, "part").orderBy("part").collect():  # one row a part
        rows_.append((r["part"], width, start, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        start += r["n_tokens"]
    staged(spark.createDataFrame(rows_, "part int, width int, start long, n_docs long, n_tokens long, root binary").coalesce(1), f"{root}/manifest")


def _rooted(recipes: DataFrame) -> DataFrame:
    """(part, root): the tree over the pages of a part, each a tree over its documents."""
    pages = recipes.select("part", "page", "local", "root").groupBy("part", "page").applyInPandas(_tree(["part", "page"], "local"), "part int, page int, root binary")
    return pages.groupBy("part").applyInPandas(_tree(["part"], "page"), "part int, root binary")


def read_store(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, recipes, manifest) of a store."""
    objects = spark.read.schema(_OBJECTS).parquet(f"{root}/objects").where("ids is not null").select("key", "ids")
    manifest = spark.read.parquet(f"{root}/manifest")
    return objects, spark.read.schema(_RECIPES).parquet(f"{root}/recipes"), manifest


def _kind(manifest: DataFrame) -> str:
    first = manifest.select("width").first()
    return f"<u{first[0] if first else 2}"


def manifest_root(manifest: DataFrame) -> str:
    """Root of the whole store, in hex."""
    return merkle([bytes(r["root"]) for r in manifest.orderBy("part").collect()]).hex()


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, row, start, ids array<int>): the ids themselves, put together again by the recipes."""
    objects, recipes, manifest = read_store(spark, root)
    kind = _kind(manifest)
    wide = recipes.join(F.broadcast(manifest.select("part", "start")), "part")
    refs = wide.select("doc_id", "row", (F.col("start") + F.col("local")).alias("start"), F.posexplode("digests").alias("i", "key"))
    joined = refs.join(objects, "key", "left").withColumn("ids", F.coalesce("ids", F.raise_error(F.lit("a chunk is missing"))))

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [np.concatenate([np.frombuffer(c["ids"], kind) for c in sorted(chunks, key=lambda c: c["i"])]).tolist() for chunks in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", "row", "start")], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "row", "start", "ids"])

    chunks = joined.groupBy("doc_id", "row", "start").agg(F.collect_list(F.struct("i", "ids")).alias("chunks"))
    return chunks.mapInArrow(decode, "doc_id long, row long, start long, ids array<int>")


def verified(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, row, start, n_tokens, ids_crc32, n_chunks) of every document, after checking every object and root."""
    objects, recipes, manifest = read_store(spark, root)
    session(objects)
    kind = _kind(manifest)

    def check_objects(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, bodies = batch.column("key").to_pylist(), batch.column("ids").to_pylist()
            if any(hashlib.sha256(b).digest() != k for k, b in zip(keys, bodies, strict=True)):
                raise ValueError("a chunk does not match its digest")
            wide = [np.frombuffer(b, kind).astype("<u4").tobytes() for b in bodies]
            arrays = [batch.column("key"), pa.array([zlib.crc32(b) for b in wide], pa.int64()), pa.array([len(b) // 4 for b in wide], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "crc", "n"])

    def check_recipes(batches):
        import itertools

        import pyarrow as pa

        for batch in batches:
            if any(merkle(d) != r for d, r in zip(batch.column("digests").to_pylist(), batch.column("root").to_pylist(), strict=True)):
                raise ValueError("a recipe does not match its root")
            after = [[sum(s) - x for x in itertools.accumulate(s)] for s in batch.column("sizes").to_pylist()]
            cols = [batch.column(n) for n in ("part", "doc_id", "row", "local", "digests")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(after, pa.list_(pa.int64()))], ["part", "doc_id", "row", "local", "digests", "after"])

    def shift(batches):
        import numpy as np
        import pyarrow as pa

        operators = zero_operators()
        for batch in batches:
            crcs = advanced(batch.column("crc").to_numpy().astype(np.uint32), batch.column("after").to_numpy() * 4, operators)
            cols = [batch.column(n) for n in ("doc_id", "row", "start", "n")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(crcs.astype(np.int64))], ["doc_id", "row", "start", "n", "crc"])

    fault = _rooted(recipes).join(manifest.select("part", F.col("root").alias("expected")), "part", "full").where("not (root <=> expected)")
    if not fault.isEmpty():
        raise ValueError("a part does not match the manifest")
    summed = objects.mapInArrow(check_objects, "key binary, crc long, n int")
    wide = recipes.mapInArrow(check_recipes, "part int, doc_id long, row long, local long, digests array<binary>, after array<long>").join(F.broadcast(manifest.select("part", "start")), "part")
    refs = wide.select("doc_id", "row", (F.col("start") + F.col("local")).alias("start"), F.explode(F.arrays_zip("digests", "after")).alias("x"))
    refs = staged(refs.select("doc_id", "row", "start", F.col("x.digests").alias("key"), "x.after"))
    uses = refs.groupBy("key").agg(F.count("*").alias("n"))
    named = uses.join(summed.withColumnRenamed("n", "size"), "key", "left").withColumn("size", F.coalesce("size", F.raise_error(F.lit("a chunk is missing"))))
    present = hot_join(refs, named, ["key"], refs.count()).withColumnRenamed("size", "n")
    parts = present.select("doc_id", "row", "start", "n", "crc", "after").mapInArrow(shift, "doc_id long, row long, start long, n int, crc long")
    return parts.groupBy("doc_id", "row", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), root, public_tokenizers.path(VOCABULARY))
    return verified(spark, root).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")
