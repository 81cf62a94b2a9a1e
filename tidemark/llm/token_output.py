"""Token ids of documents in files of independently compressed records.

Format, a folder of two Parquet tables written by Spark:

``dictionary``: one row with ``hash`` (xxh64 of the bytes, hex), ``width`` (bytes of an id)
and ``bytes`` (a zstandard dictionary trained on serialized id arrays, empty if there was
too little to train on).

``shards``: a row for each run of documents in ascending doc_id order: ``part`` and ``seq``
(order of the rows), ``first_id``, ``last_id`` (statistics that let a reader skip shards),
``n_tokens``, ``dictionary`` (its hash), the offset index ``doc_ids``, ``counts``,
``offsets`` (one more than documents) and ``data``, the documents' zstandard frames. A
frame holds one document's ids, little-endian and ``width`` bytes each, compressed on its
own with the shared dictionary, so a short document is read without its neighbours.

Documents are range-partitioned by doc_id before they are encoded, so a task holds one
range and only the dictionary's sample is looked at twice. Files go through Spark's writer
and committer: a task that is run again replaces what it wrote.

Defined results: a null or empty text is the end id alone; a null doc_id comes first;
repeated doc_ids are kept, next to each other, ordered by text; an empty table gives files
without shards; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.frames import append, map_arrow

DICTIONARY_BYTES = 64 << 10
# About so many documents, and at most so many bytes of each one's ids, train the dictionary.
SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 16 << 10
SHARD_BYTES = 4 << 20
SHARD_DOCS = 4_096
# Documents encoded together; an Arrow batch, which holds 8 MB or one document, bounds their size.
AT_ONCE = 512
LEVEL = 3
SHARDS = (
    "part int, seq int, first_id bigint, last_id bigint, n_tokens bigint, dictionary string, "
    "doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, data binary"
)
READ = "part int, seq int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
# A space that begins a token: tokens never reach over it.
_ODD = re.compile(r" (?![!-~\w])")
_CUT = re.compile(r"(?= [!-~\w])")
_MOST_PIECES = 800_000
_LONGEST_PIECE = 48


def _solid(parts: list[str]) -> bool:
    """Whether no part is empty, begins or ends with white space."""
    return all(x and not x[0].isspace() and not x[-1].isspace() for x in parts)


class Known:
    """Ids of pieces seen before, in two generations.

    When the young one is full it becomes the old one, whose pieces come back as they are seen
    again: memory is bounded and what is frequent is never forgotten.
    """

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most // 2

    def values(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Their ids, None where unknown, and where that is; pieces of the old generation become young."""
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        gaps = [i for i, v in enumerate(found) if v is None]
        if old and gaps:
            back = list(map(old.get, [pieces[i] for i in gaps]))
            for i, v in zip(gaps, back, strict=True):
                if v is not None:
                    found[i] = young[pieces[i]] = v
            gaps = [i for i, v in zip(gaps, back, strict=True) if v is None]
        return found, gaps

    def missing(self, pieces) -> set[str]:
        """Which of the pieces are unknown; pieces of the old generation become young."""
        some = list(pieces)
        return {some[i] for i in self.values(some)[1]}

    def grow_old(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def forget(self, pieces) -> None:
        """Long pieces are not worth their memory."""
        for p in [p for p in pieces if len(p) > _LONGEST_PIECE]:
            self.young.pop(p, None)


class Encoder:
    """Ids of texts, one piece at a time: pieces seen before are looked up.

    The vocabulary's pre-tokenizer always begins a token at a space that a visible
    character follows, so a text's ids are those of its pieces, one after the other. Nor
    does a token reach over a line break between visible characters, or from a letter to a
    mark that ends its piece, so new pieces are made of known ones where possible. Texts with
    the string of a special token go to the tokenizer whole, as it cuts them there first.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = dtype
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids of pieces after a space, and of pieces without one before them.
        self.spaced, self.bare = Known(_MOST_PIECES), Known(_MOST_PIECES // 4)
        gap = self._plain(["\t"])[0]
        self.gap = int(np.frombuffer(gap, dtype)[0]) if len(gap) == np.dtype(dtype).itemsize else None
        self.line = self._plain(["\n"])[0]
        self.marks = dict(zip(".,;:!?", self._plain(list(".,;:!?")), strict=True))

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _encode_new(self, pieces: list[str], known: dict[str, bytes], before: str) -> None:
        """Encodes pieces together, set apart by a tab, which is a token of its own there."""
        if self.gap is None:
            joint, alone = [], pieces
        else:
            joint = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace() and "\t" not in p]
            alone = [p for p in pieces if not p or p[0].isspace() or p[-1].isspace() or "\t" in p] if len(joint) < len(pieces) else []
        apart = f"\t{before}"
        for at in range(0, len(joint), 512):
            some = joint[at : at + 512]
            ids = np.frombuffer(self._plain([before + apart.join(some)])[0], self.dtype)
            cuts = np.flatnonzero(ids == self.gap)
            if len(cuts) != len(some) - 1:
                alone += some
                continue
            size, data = ids.itemsize, ids.tobytes()
            starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(data)]
            known.update(zip(some, map(data.__getitem__, map(slice, starts, ends)), strict=True))
        known.update(zip(alone, self._plain([before + p for p in alone]), strict=True))

    def _learn(self, spaced: set[str], bare: set[str]) -> None:
        """Adds the ids of unknown pieces, after a space and without one."""
        new, kinds = (set(), set()), (self.spaced, self.bare)
        made: list[tuple[int, str, list[str], str]] = []
        marks = self.marks
        parted: tuple[set[str], set[str]] = (set(), set())
        for place, pieces in enumerate((spaced, bare)):
            marked = [p for p in pieces if p[-1:] in marks and p[-2:-1].isalpha() and "\n" not in p]
            stems = [p[:-1] for p in marked]
            made += [(place, p, [stem], p[-1]) for p, stem in zip(marked, stems, strict=True)]
            parted[place].update(stems)
            fresh = new[place]
            fresh.update(pieces)
            fresh.difference_update(marked)
            for p in [p for p in fresh if "\n" in p]:
                if _solid(parts := p.split("\n")):
                    made.append((place, p, parts, ""))
                    parted[place].add(parts[0])
                    parted[1].update(parts[1:])
                    fresh.discard(p)
        for place, before in ((0, " "), (1, "")):
            new[place].update(kinds[place].missing(parted[place]))
            self._encode_new(list(new[place]), kinds[place].young, before)
        rest = self.bare.young
        for place, p, parts, mark in made:
            known = kinds[place].young
            value = known[parts[0]]
            if len(parts) > 1:
                value = self.line.join([value, *map(rest.__getitem__, parts[1:])])
            known[p] = value + self.marks[mark] if mark else value
        self.spaced.forget(parted[0])
        self.bare.forget(parted[1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The serialized ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, t in enumerate(texts):
            kinds[2 if any(s in t for s in self.specials) else 1 if _ODD.search(t) else 0].append(i)
        for places, of in zip(kinds, (self._encode_plain, self._encode_odd, self._plain), strict=True):
            for i, ids in zip(places, of([texts[i] for i in places]) if places else (), strict=True):
                out[i] = ids
        return out

    def _ids_of(self, spaced: list[str], bare: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of pieces after a space and of pieces without one; of either, each is given once."""
        self.spaced.grow_old()
        self.bare.grow_old()
        # Each piece is looked up once, only those not known a second time.
        (after, no_after), (alone, no_alone) = self.spaced.values(spaced), self.bare.values(bare)
        new, fresh = {spaced[i] for i in no_after}, {bare[i] for i in no_alone}
        if new or fresh:
            self._learn(new, fresh)
        for found, gaps, known, some in ((after, no_after, self.spaced, spaced), (alone, no_alone, self.bare, bare)):
            for i in gaps:
                found[i] = known.young[some[i]]
        self.spaced.forget(new)
        self.bare.forget(fresh)
        return after, alone

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts whose pieces are what lies between single spaces: split and looked up by Arrow."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = coded.dictionary.take(pa.array(places[edges[:-1]])).dictionary_encode()
        places[edges[:-1]] = len(coded.dictionary) + heads.indices.to_numpy(zero_copy_only=False)
        spaced, bare = self._ids_of(*(x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (coded, heads)))
        joined = pa.array([*spaced, *bare], pa.large_binary()).take(pa.array(places))
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[edges].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def _encode_odd(self, texts: list[str]) -> list[bytes]:
        """Texts in which a space may belong to the token before it, cut where it does not."""
        cut = [_CUT.split(t) for t in texts]
        spaced = {p: i for i, p in enumerate({p[1:] for _, *rest in cut for p in rest})}
        bare = {p: i for i, p in enumerate({first for first, *_ in cut})}
        after, alone = self._ids_of(list(spaced), list(bare))
        return [b"".join([alone[bare[first]], *[after[spaced[p[1:]]] for p in rest]]) for first, *rest in cut]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, dtype: str) -> Encoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def _width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int) -> bytes:
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def make():
        encoder, end = _encoder(tokenizer, f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()

        def work(batch):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            return [[(x + end)[:SAMPLE_BYTES] for x in encoder.encode(texts)]]

        return work

    samples = sorted(bytes(r[0]) for r in append(some, "_ids binary", make).select("_ids").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> str:
    """Encodes docs (doc_id, text) and writes the files of the format to path."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    width = _width(tokenizer)
    trained = train_dictionary(docs, tokenizer, width, end_id)
    name = xxhash.xxh64_hexdigest(trained)
    spark.createDataFrame([(name, width, bytearray(trained))], "hash string, width int, bytes binary").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(trained)

    def run(batches):
        from pyspark import TaskContext

        encoder, end = _encoder(tokenizer, f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()
        packer = _compressor(shared.value)
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def shard():
            kinds = [k.type for k in _shard_schema()]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            seen = [i for i in ids if i is not None]
            row = [part, seq, min(seen, default=None), max(seen, default=None), sum(counts), name, ids, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], schema=_shard_schema())

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), AT_ONCE):
                made = encoder.encode([x or "" for x in texts[at : at + AT_ONCE]])
                for doc_id, data in zip(doc_ids[at : at + AT_ONCE], made, strict=True):
                    data += end
                    frames.append(packer.compress(data))
                    ids.append(doc_id)
                    counts.append(len(data) // width)
                    size += len(frames[-1])
                    if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                        yield shard()
                        seq += 1
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield shard()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, run, SHARDS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/shards")
    return path


def _shard_schema() -> pa.Schema:
    long = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), long, long, long, pa.binary()]
    return pa.schema(list(zip([c.split()[0] for c in SHARDS.split(", ")], kinds, strict=True)))


def _compressor(trained: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def _decompressor(trained: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def _documents(shard: dict, trained: bytes, name: str, width: int, wanted: int | None = None):
    """(doc_id, tokens before it in the shard, ids) of a shard's documents."""
    if shard["dictionary"] != name:
        raise ValueError(f"shard needs dictionary {shard['dictionary']}, the folder has {name}")
    unpacker, data, before = _decompressor(trained), shard["data"], 0
    places = zip(shard["doc_ids"], shard["counts"], shard["offsets"], shard["offsets"][1:], strict=False)
    for doc_id, count, start, end in places:
        if wanted is None or doc_id == wanted:
            yield doc_id, before, np.frombuffer(unpacker.decompress(data[start:end]), f"<u{width}")
        before += count


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    trained = bytes(row["bytes"])
    if xxhash.xxh64_hexdigest(trained) != row["hash"]:
        raise ValueError(f"the dictionary in {path} is not the one that was written")
    return trained, row["hash"], row["width"]


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Sums run per shard, then per part, then over the parts, of which there are as many as
    the writing job had tasks.
    """
    trained, name, width = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(trained)
    shards = spark.read.parquet(f"{path}/shards")

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                rows = [
                    (shard["part"], shard["seq"], doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, before, ids in _documents(shard, shared.value, name, width)
                ]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ.split(", ")])

    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_part_start"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_seq_start")).join(parts, "part")
    return (
        map_arrow(shards, run, READ)
        .join(starts, ["part", "seq"])
        .select("doc_id", (F.col("_part_start") + F.col("_seq_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with that id: only shards that may hold it are opened."""
    trained, name, width = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    rows = shards.orderBy("part", "seq").toLocalIterator()
    return [ids.tolist() for r in rows for _, _, ids in _documents(r.asDict(), trained, name, width, doc_id)]
