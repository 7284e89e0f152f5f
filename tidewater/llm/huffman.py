"""Token ids in files: canonical length-limited Huffman codes in blocks with bit-offset checkpoints."""

from __future__ import annotations

import bisect
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import shared

#: Codes of up to 16 bits, or of one more than all used ids need; a decoding table has an entry for each such string.
MOST_BITS = 16
LANE = 128
BLOCK = 1 << 17
#: Words and units whose ids a worker keeps: about 40 bytes each, and CACHED_BYTES for each of them at most.
CACHED_WORDS = 200_000
CACHED_UNITS = 400_000
CACHED_BYTES = 100
#: Letters of a piece of a text, and how many such pieces are encoded together.
PART = 1 << 16
TOGETHER = 64
_SPACE = re.compile("[\t-\r ]")
#: Where word_bpe_49k.json cuts lower-cased text. Below U+0250 characters have settled classes and are
#: composed already; what lower-casing takes beyond is not cut by this pattern.
_LATIN = 0x250
_KINDS = {k: "".join(re.escape(chr(c)) for c in range(_LATIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_UNITS = rf"'(?:s|t|re|ve|m|ll|d)|[{_KINDS['L']}]+|[{_KINDS['N']}]|[^{_KINDS['L']}{_KINDS['N']}\t-\r \x85\xa0]+"
_OTHER = re.compile(f"[{chr(_LATIN)}-\U0010ffff]")


def _ends(cells: pa.BinaryArray) -> np.ndarray:
    """Where the cells of a column begin and end in its data."""
    return np.frombuffer(cells.buffers()[1], dtype="<i4")[cells.offset : cells.offset + len(cells) + 1] if len(cells) else np.zeros(1, dtype="<i4")


def _cells(ends: np.ndarray, data: pa.Buffer | None) -> pa.BinaryArray:
    """A column of cells that end there in the data."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i4").tobytes()), data])


class Known:
    """Ids of strings that were met, a cell (little-endian, of 32 bits) each."""

    def __init__(self) -> None:
        self.names, self.cells = pa.array([], pa.string()), pa.array([], pa.binary())
        self.used, self.now = np.zeros(0, dtype=np.int64), 0

    def __len__(self) -> int:
        return len(self.names)

    def ids(self, names: pa.StringArray, make: Callable[[pa.StringArray], pa.BinaryArray], most: int) -> pa.BinaryArray:
        """The cells of distinct names; make() gives those of new ones. Beyond `most`, or its bytes, half of it is kept: what was used last."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        at[new] = len(self) + np.arange(new.sum())
        fresh = names.filter(pa.array(new))
        self.names, self.cells = pa.concat_arrays([self.names, fresh]), pa.concat_arrays([self.cells, make(fresh)])
        self.now += 1
        self.used = np.append(self.used, np.zeros(len(fresh), dtype=np.int64))
        self.used[at] = self.now
        found = self.cells.take(pa.array(at))
        if len(self) > most or self.names.nbytes + self.cells.nbytes > CACHED_BYTES * most:
            kept = np.argsort(-self.used, kind="stable")[: most // 2]
            size = pc.add(pc.binary_length(self.names), pc.binary_length(self.cells)).to_numpy(zero_copy_only=False)[kept] + 8
            kept = kept[: np.searchsorted(np.cumsum(size), CACHED_BYTES * most // 2, side="right")]
            self.names, self.cells, self.used = self.names.take(pa.array(kept)), self.cells.take(pa.array(kept)), self.used[kept]
        return found


class UnitEncoder:
    """Encodes texts by the units that merges never cross, each unit once.

    Texts are cut at ASCII white space if the tokenizer drops it (as it is tested on start), and given to it whole if
    not; the distinct words of some texts are looked up together. For the tokenizer that _UNITS describes, Latin words
    without special tokens are cut by that pattern; all other words are units as they are.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in made["added_tokens"]]
        norms, cuts = made["normalizer"] or {}, made["pre_tokenizer"] or {}
        split = (cuts.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.units = re.compile(_UNITS) if split == known and [x["type"] for x in norms.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] else None
        probe = "One twO, 3's\t<a> \n\x0b b_c  d"
        if self.units:
            made["normalizer"] = None  # units are composed, lower-cased and without white space
        self.plain = Tokenizer.from_str(json.dumps(made)) if self.units else self.tokenizer
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words = self._ids([probe])[0] == [i for ids in self._ids(re.split("[\t-\r ]+", probe)) for i in ids]
        self.word, self.place = Known(), Known()

    def _ids(self, texts: list[str], plain: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _settled(self, text: str) -> bool:
        """Whether _UNITS cuts a text: Latin only, also once lower-cased, and without special tokens."""
        return self.units is not None and not any(x in text for x in self.special) and not _OTHER.search(text.lower())

    def _units_ids(self, units: list[str], line: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in one array, and how many each has: a line of units at once if all are settled (so lower-cased) and each ends in an end of a word."""
        if self._settled(" ".join(units)):
            flat = np.fromiter(itertools.chain.from_iterable(self._ids([" ".join(units[a : a + line]) for a in range(0, len(units), line)], plain=True)), dtype=np.int64)
            ends = np.flatnonzero(self.ends[flat])
            if len(ends) == len(units):
                return flat, np.diff(ends, prepend=-1)
        lists = self._ids(units)
        return np.array([x for own in lists for x in own], dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)

    def _unit_cells(self, names: pa.StringArray) -> pa.BinaryArray:
        units, out, sizes = names.to_pylist(), [], [[0]]
        for a in range(0, len(units), 5000):
            ids, size = self._units_ids(units[a : a + 5000])
            out.append(ids.astype("<u4").tobytes())
            sizes.append(4 * size)
        return _cells(np.cumsum(np.concatenate(sizes)), pa.py_buffer(b"".join(out)))

    def _cut(self, words: list[str]) -> list[Sequence[str]]:
        """The units of each word."""
        together = "\n".join(words)
        if words and self._settled(together):
            return [(w,) if w.isalpha() else self.units.findall(w) for w in together.lower().split("\n")]
        return [self.units.findall(w.lower()) if self._settled(w) else (w,) for w in words]

    def _word_cells(self, names: pa.StringArray) -> pa.BinaryArray:
        cut = self._cut(names.to_numpy(zero_copy_only=False).tolist())
        units = pa.array(list(itertools.chain.from_iterable(cut)), pa.string()).dictionary_encode()
        cells = self.place.ids(units.dictionary, self._unit_cells, CACHED_UNITS).take(units.indices)
        return _cells(_ends(cells)[np.cumsum([0, *map(len, cut)])], cells.buffers()[2])

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts of about PART letters, cut at white space, where that changes no id."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + PART) if self.words and len(text) - at > PART else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of texts in one array, and how many each has."""
        texts = pa.array(parts, pa.string())
        cut = pc.ascii_split_whitespace(texts) if self.words else pa.ListArray.from_arrays(np.arange(len(parts) + 1, dtype=np.int32), texts)
        words = cut.flatten().dictionary_encode()
        cells = self.word.ids(words.dictionary, self._word_cells, CACHED_WORDS).take(words.indices)
        return numbers(cells, "<u4"), np.diff(_ends(cells)[cut.offsets.to_numpy()]) // 4

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        counts, out, held, owner, room = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=np.uint32)], [], [], 0

        def settle() -> None:
            ids, sizes = self._encode(held)
            out.append(ids)
            np.add.at(counts, owner, sizes)
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for part in self._parts(text):
                held.append(part)
                owner.append(i)
                room += len(part)
                if room >= TOGETHER * PART:
                    settle()
                    room = 0
        if held:
            settle()
        return np.concatenate(out), counts


_encoders: dict[str, UnitEncoder] = {}


def _encoder(path: str) -> UnitEncoder:
    """The encoder of this worker process, which keeps the units it has met from task to task."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a batch (key, text) with the ids of each text and the end id, some texts at a time."""
    encoder, a = _encoder(path), 0
    texts = batch.column(1)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER * PART, side="right")))
        part = batch.slice(a, b - a)
        ids, counts = encoder.encode([t or "" for t in part.column(1).to_pylist()])
        stops = np.cumsum(counts)
        ids = np.insert(ids, stops, end_id).astype("<u4")
        yield part, np.split(ids, (stops + np.arange(1, len(stops) + 1))[:-1])
        a = b


def kind_of(path: str) -> str:
    """The smallest kind of number that has a vocabulary's ids."""
    return "<u2" if _encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, kind: str = "<u4") -> DataFrame:
    """key, ids (binary, little-endian, unsigned of 32 bits or as `kind` says): the tokens of each whole text and the end id.

    A null text is empty; repeated rows are documents of their own; other columns of docs are not read, whatever their
    names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids in encoded(batch, path, end_id):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=[key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary")


def numbers(ids: pa.BinaryArray, kind: str) -> np.ndarray:
    """All numbers of a column of binary cells, one after the other, without a copy."""
    if not len(ids):
        return np.zeros(0, dtype=kind)
    ends = np.frombuffer(ids.buffers()[1], dtype="<i8" if pa.types.is_large_binary(ids.type) else "<i4")[ids.offset : ids.offset + len(ids) + 1]
    return np.frombuffer(ids.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, dtype=kind)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (0 for ids that don't occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 2**most:
        raise ValueError(f"{len(used)} ids don't fit into codes of {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    row, leaf_rows = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(most - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        row = both[order]
        leaf_rows.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for leaf in reversed(leaf_rows):
        n = int(leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by id, and the table that gives id and length for each string of as many bits as the longest code has."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    most = int(lengths.max(initial=0))
    span = np.left_shift(1, most - lengths[used])
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[used] = first >> (most - lengths[used])
    table = np.zeros(1 << most, dtype=np.uint32)
    table[: span.sum()] = np.repeat(used, span)
    return codes, table, lengths[table]


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the codes of several documents, each from a byte of its own; bytes of each; bit offsets (in its document) of every LANE-th id; how many each has."""
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.cumsum(counts) - counts
    room = -(-(ends[first + counts] - ends[first]) // 8)
    begin = np.cumsum(room) - room
    at = ends[:-1] + np.repeat(8 * begin - ends[first], counts)
    shifted = codes[ids] << (32 - size - (at & 7))
    out = np.zeros(int(room.sum()) + 4)
    for k in range(4):
        out += np.bincount((at >> 3) + k, weights=(shifted >> (24 - 8 * k)) & 255, minlength=len(out))[: len(out)]
    lanes = -(-counts // LANE)
    lane = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    return out.astype(np.uint8)[: int(room.sum())], room, at[lane] - np.repeat(8 * begin, lanes), lanes


def unpack(bits: bytes, marks: np.ndarray, counts: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of all documents of a block; all lanes are decoded in step, each from its checkpoint."""
    most = len(table).bit_length() - 1
    b = np.concatenate([np.frombuffer(bits, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.int64)
    words = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    lanes = -(-counts // LANE)
    last = np.cumsum(lanes)
    n = np.full(len(marks), LANE)
    n[last[lanes > 0] - 1] = (counts - LANE * (lanes - 1))[lanes > 0]
    order = np.argsort(-n, kind="stable")
    at, out = marks[order].astype(np.int64), np.zeros((LANE, len(marks)), dtype="<u4")
    active = np.searchsorted(-n[order], -np.arange(LANE), side="left")
    for step in range(LANE):
        k = active[step]
        if not k:
            break
        window = (words[at[:k] >> 3] >> (32 - most - (at[:k] & 7))) & ((1 << most) - 1)
        out[step, :k] = table[window]
        at[:k] += lengths[window]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.T[back][np.arange(LANE) < n[:, None]]


def write(tokens: DataFrame, path: str, key: str = "doc_id", kind: str = "<u4") -> None:
    """Writes key, ids (as tokenize() gives them, of the same kind) into `path`, in ascending order of key (null first; equal ones as they stand in the table).

    path/code: id, bits, the lengths that define the canonical code. path/blocks: part, nr, start (ids of the part
    before the block), keys, sizes (ids of each document), marks (checkpoints: bit offset in the block of each
    LANE-th id of each document), bits. Blocks decode on their own; a document is never split and starts at a byte.
    Parts are ranges of keys and of places in the table, so that rows of one key (or null) spread over parts; their
    bounds come from the keys alone. Only packed documents are shuffled. The counts of ids on the driver are bounded by
    the vocabulary. An empty table gives files without blocks. tokens is read several times: a saved table.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            own = np.bincount(numbers(batch.column(0), kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    spark = tokens.sparkSession
    counts = tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    dense[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(dense, max(MOST_BITS, len(counts).bit_length() + 1))
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used, "bits": lengths[used]}), "id long, bits long").coalesce(1).write.parquet(f"{path}/code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = tokens.select(F.col(key).alias("key"), "ids").withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc()]
    ranged = placed.select("key", "tie").repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("key").isNotNull(), "key", "tie")).alias("least"))
    bounds = sorted((r.least[0], 0 if r.least[1] is None else r.least[1], r.least[2]) for r in ranged.collect())[1:]
    shipped = spark.sparkContext.broadcast((canonical(lengths)[0], lengths))
    key_kind = to_arrow_schema(placed.schema).field("key").type

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = shipped.value
        for batch in batches:
            keys, ties, n = batch.column(0).to_pylist(), batch.column(2).to_pylist(), pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // BLOCK, prepend=0))):
                if not len(some):
                    continue
                a, b = int(some[0]), int(some[-1]) + 1
                ids = numbers(batch.column(1)[a:b], kind)
                out, room, marks, lanes = pack(ids.astype(np.int64), n[a:b].astype(np.int64), codes, bits)
                at = [bisect.bisect_right(bounds, (k is not None, 0 if k is None else k, tie)) for k, tie in zip(keys[a:b], ties[a:b], strict=True)]
                cells = [pa.array(at, pa.int32()), batch.column(0)[a:b], batch.column(2)[a:b], pa.array(n[a:b].astype(np.int32))]
                cells += [pa.array([x.tobytes() for x in np.split(data, np.cumsum(size)[:-1])], pa.binary()) for data, size in ((marks.astype("<u4"), lanes), (out, room))]
                yield pa.RecordBatch.from_arrays(cells, names=["part", "key", "tie", "n", "marks", "bits"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nr, start, held, room = 0, 0, 0, [], 0

        def block() -> pa.RecordBatch:
            keys, sizes, marks, bits = zip(*held, strict=True)
            base = 8 * np.cumsum([0, *map(len, bits[:-1])])
            moved = np.concatenate([np.frombuffer(m, dtype="<u4") + b for m, b in zip(marks, base, strict=True)])
            cells = [pa.array([at], pa.int32()), pa.array([nr], pa.int32()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(key_kind)), pa.array([sizes], pa.list_(pa.int32()))]
            cells += [pa.array([x], pa.binary()) for x in (moved.astype("<u4").tobytes(), b"".join(bits))]
            return pa.RecordBatch.from_arrays(cells, names=["part", "nr", "start", "keys", "sizes", "marks", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                part, one, n, marks, bits = (c[i].as_py() for c in batch.columns)
                if held and (part != at or room >= BLOCK):
                    yield block()
                    nr, start, held, room = nr + 1, start + room, [], 0
                if part != at:
                    at, nr, start = part, 0, 0
                held.append((one, n, marks, bits))
                room += n
        if held:
            yield block()

    name = tokens.schema[key].dataType.simpleString()
    rows = placed.select("key", "ids", "tie").mapInArrow(packed, f"part int, key {name}, tie long, n int, marks binary, bits binary")
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", *order).select("part", "key", "n", "marks", "bits")
    ordered.mapInArrow(blocks, f"part int, nr int, start long, keys array<{name}>, sizes array<int>, marks binary, bits binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), ids (binary) of what write() wrote; nothing from empty files."""
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, dtype=np.int64)
    lengths[code["id"].to_numpy(dtype=np.int64)] = code["bits"].to_numpy(dtype=np.int64)
    shipped = spark.sparkContext.broadcast(canonical(lengths)[1:])
    blocks = spark.read.parquet(f"{path}/blocks")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    parts = blocks.groupBy("part").agg(F.sum(total).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.join(parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "part")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, sizes, marks, data, start, base = (c[i] for c in batch.columns)
                sizes = sizes.values.to_numpy().astype(np.int64)
                ids = unpack(data.as_py(), np.frombuffer(marks.as_buffer(), dtype="<u4"), sizes, table, bits)
                ends = np.cumsum(sizes)
                out = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * np.append(0, ends)).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(base.as_py() + start.as_py() + ends - sizes), out], names=[key, "start", "ids"])

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    chosen = based.select("keys", "sizes", "marks", "bits", "start", F.col("_base").alias("base"))
    return chosen.mapInArrow(decoded, f"`{key}` {kind}, start long, ids binary")
