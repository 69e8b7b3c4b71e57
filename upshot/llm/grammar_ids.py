"""Token ids in binary files compressed by a grammar (Re-Pair).

Documents go in ascending id order, each as its token ids and an end id. Their ids
are cut into shards of ``SHARD_IDS``, and in each shard the frequent pairs of
neighbouring symbols are replaced by new symbols (nonterminals), again and again,
until no pair stands ``MIN_COUNT`` times or the symbols' width is used up. A round
replaces several pairs at once: the most frequent first, each only if none of its
symbols stands on the other side of a pair taken before, so that no two places
overlap; places of a pair of equal symbols are taken from the left of each run.

File: the magic, shards, a table of the shards and a tail with the table's place.

* shard: a header of little-endian int64 (terminals, rules, symbols, documents, ids,
  bytes of a symbol), the rules as pairs of symbols, the rules' expansion lengths
  (uint32), the symbols, then the shard's part of each document: id (int64), number
  of ids (int64), flags (1: has an id, 2: begins here, 4: ends here).
* table: of each shard its offset, ids before it in the file, ids, documents.

Rule ``r`` is symbol ``terminals + r`` and refers to earlier symbols only. From the
expansion lengths a reader knows which symbols cover a range of ids and expands no
other (:func:`read_range`).

Distribution: texts are sorted by a range exchange on (id, text hash), so a frequent
id is cut too; each task encodes, compresses and writes its range as one file, named
anew at each attempt, and only files of finished tasks are in the manifest. A task
holds one text and one shard. The vocabulary's pattern drops white space, so a text's
ids are those of its words, split at ASCII white space, end to end, and words are held.

Defined cases: a null or empty text has the end id alone; null ids come first; rows
that repeat an id are documents of their own, in the order of their text's hash; an
empty table gives an empty manifest and result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BINARY, INT, LONG, STRING, documents, materialise, open_file, schema, scratch_path, ship_package
from .packing import bytes_of_letters

SHARD_IDS = 4 << 20
PART_BYTES = 32 << 20  # text bytes a file
MIN_COUNT = 64
SHARE = 1024  # a round takes the pairs at least 1 / SHARE as frequent as the first
END_ID = 2
WORDS_HELD = 300_000  # in each of two generations
MAGIC, HEADER, ENTRY, TAIL = b"UPSHIDS1", struct.Struct("<6q"), struct.Struct("<4q"), struct.Struct("<2q")
HAS_ID, BEGINS, ENDS = 1, 2, 4
LATIN = "\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017f"
SIGNS = ".,;:!?"
PLAIN = re.compile(f"[!-~\\u00d7\\u00f7{LATIN}]+")
#: the vocabulary's own pattern on such words
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{LATIN}]+|[0-9]|[^A-Za-z{LATIN}0-9]+")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """``bytes of a text -> ids``, word by word (words by ASCII white space).

    Words of plain Latin letters, digits and signs go through the byte-pair routine of
    tiktoken on the file's vocabulary, in which a byte that no text has stands for the
    end of a word; any other word, and any with an added token, through the tokenizers
    library. Words are held in two generations, so frequent ones are encoded once."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, letters = spec["model"]["end_of_word_suffix"], bytes_of_letters()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {}
        for word, i in spec["model"]["vocab"].items():
            if word not in added:
                whole = word.endswith(suffix)
                ranks[bytes(letters[c] for c in (word.removesuffix(suffix) if whole else word)) + (b"\xff" if whole else b"")] = i
        self.pair = tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.new, self.old, self.tails = {}, {}, {}

    def word(self, word: bytes) -> bytes:
        """Ids of a word as little-endian uint32."""
        text = word.decode("utf-8", "replace")
        core = text.rstrip(SIGNS)
        if core.isalpha() and (core.isascii() or (max(core) <= "\u017f" and "\u0130" not in core)):  # letters, then signs or nothing
            ids = self.pair(core.lower().encode() + b"\xff")
            if len(core) < len(text):
                ids += self.tail(text[len(core):])
        elif PLAIN.fullmatch(text) and "<|" not in text:
            ids = []
            for piece in PIECES.findall(text.lower()):
                ids += self.pair(piece.encode() + b"\xff")
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def tail(self, signs: str) -> list[int]:
        found = self.tails.get(signs)
        if found is None:
            found = self.pair(signs.encode() + b"\xff")
            if len(signs) <= 4:  # few of them
                self.tails[signs] = found
        return found

    def _first(self, word: bytes) -> bytes:
        found = self.old.get(word) or self.word(word)
        if len(word) <= 64:
            self.new[word] = found
        return found

    def ids(self, text: bytes) -> np.ndarray:
        get, first = self.new.get, self._first
        out = b"".join([get(w) or first(w) for w in text.split()])
        if len(self.new) > WORDS_HELD:
            self.new, self.old = {}, self.new
        return np.frombuffer(out, dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _choose(pairs: np.ndarray, counts: np.ndarray, bits: int, room: int) -> list[int]:
    """Places in ``pairs`` of those to replace in a round, the most frequent first."""
    left, right, chosen = set(), set(), []
    low = (1 << bits) - 1
    for i in np.lexsort((pairs, -counts)).tolist():
        pair = int(pairs[i])
        a, b = pair >> bits, pair & low
        if a in right or b in left or (a == b and (a in left or b in right)):
            continue
        left.add(a)
        right.add(b)
        chosen.append(i)
        if len(chosen) == room:
            break
    return chosen


def compress(ids: np.ndarray, terminals: int, min_count: int = MIN_COUNT, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """``(rules, symbols)`` of some ids below ``terminals``."""
    narrow = terminals < 1 << 16
    bits, kind, wide = (16, np.uint16, np.uint32) if narrow else (32, np.uint32, np.uint64)
    room = (1 << 16) - terminals if narrow else 1 << 16
    x, rules = ids.astype(kind), []
    while len(x) > 1 and len(rules) < room:
        key = (x[:-1].astype(wide) << wide(bits)) | x[1:]
        key.sort()
        last = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
        counts = np.diff(last, prepend=-1)
        top = int(counts.max())
        if top < min_count:
            break
        frequent = counts >= max(min_count, top // share)
        pairs, counts = key[last[frequent]], counts[frequent]
        pairs = pairs[_choose(pairs, counts, bits, room - len(rules))]
        left, right = (pairs >> wide(bits)).astype(np.int64), (pairs & wide((1 << bits) - 1)).astype(np.int64)
        symbol = (terminals + len(rules) + np.arange(len(pairs))).astype(kind)
        rules.extend(zip(left.tolist(), right.tolist(), strict=True))
        size = terminals + len(rules)
        begins, follows = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        begins[left], follows[right] = True, True
        at = np.flatnonzero(begins.take(x)[:-1] & follows.take(x)[1:])
        order = np.argsort(pairs)
        here = (x[at].astype(wide) << wide(bits)) | x[at + 1]
        place = np.minimum(np.searchsorted(pairs[order], here), len(pairs) - 1)
        hit = pairs[order][place] == here
        at, new = at[hit], symbol[order][place[hit]]
        twin = x[at] == x[at + 1]
        if twin.any():
            number = np.arange(len(at))
            follows_on = np.zeros(len(at), dtype=bool)
            follows_on[1:] = twin[1:] & twin[:-1] & (at[1:] == at[:-1] + 1)
            run = np.maximum.accumulate(np.where(follows_on, 0, number))
            taken = (number - run) % 2 == 0
            at, new = at[taken], new[taken]
        x[at] = new
        keep = np.ones(len(x), dtype=bool)
        keep[at + 1] = False
        x = x[keep]
    return np.array(rules, dtype=kind).reshape(-1, 2), x


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    out = [1] * terminals
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out[terminals:], dtype="<u4")


@dataclass
class Shard:
    """A shard as read: grammar, symbols and its part of each document."""

    terminals: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    doc_ids: np.ndarray
    doc_counts: np.ndarray
    flags: np.ndarray

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``start + n``; only the symbols over them are expanded."""
        size = np.concatenate([np.ones(self.terminals, dtype=np.int64), self.lengths.astype(np.int64)])
        end = np.cumsum(size[self.symbols])
        total = int(end[-1]) if len(end) else 0
        stop = total if n is None else min(start + n, total)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = np.searchsorted(end, start, side="right"), np.searchsorted(end, stop - 1, side="right")
        got = self._expand(self.symbols[first:last + 1], size)
        skip = start - (int(end[first - 1]) if first else 0)
        return got[skip:skip + stop - start]

    def _expand(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        used = np.zeros(len(size), dtype=bool)
        used[symbols] = True
        for r in range(len(self.rules) - 1, -1, -1) if used[self.terminals:].any() else ():
            if used[self.terminals + r]:
                used[self.rules[r]] = True
        text = {}
        for r in np.flatnonzero(used[self.terminals:]).tolist():
            parts = [text[s] if s >= self.terminals else np.array([s], dtype="<u4") for s in self.rules[r].tolist()]
            text[self.terminals + r] = np.concatenate(parts)
        at = np.zeros(len(size), dtype=np.int64)
        at[:self.terminals] = np.arange(self.terminals)
        book, held = [np.arange(self.terminals, dtype="<u4")], self.terminals
        for s, ids in text.items():
            at[s] = held
            held += len(ids)
            book.append(ids)
        n = size[symbols]
        where = np.repeat(at[symbols] - (np.cumsum(n) - n), n)
        where += np.arange(len(where))
        return np.concatenate(book)[where]


def pack_shard(ids: np.ndarray, terminals: int, docs: list[tuple[int | None, int, int]], min_count: int = MIN_COUNT) -> bytes:
    rules, symbols = compress(ids, terminals, min_count)
    head = HEADER.pack(terminals, len(rules), len(symbols), len(docs), len(ids), symbols.itemsize)
    return b"".join([head, rules.tobytes(), expansion_lengths(rules, terminals).tobytes(), symbols.tobytes(),
                     np.array([i or 0 for i, _, _ in docs], dtype="<i8").tobytes(),
                     np.array([n for _, n, _ in docs], dtype="<i8").tobytes(),
                     np.array([f for _, _, f in docs], dtype="u1").tobytes()])


def unpack_shard(data: bytes) -> Shard:
    terminals, n_rules, n_symbols, n_docs, _, width = HEADER.unpack_from(data)
    kind, at, parts = f"<u{width}", HEADER.size, []
    for dtype, n in ((kind, 2 * n_rules), ("<u4", n_rules), (kind, n_symbols), ("<i8", n_docs), ("<i8", n_docs), ("u1", n_docs)):
        parts.append(np.frombuffer(data, dtype=dtype, count=n, offset=at))
        at += parts[-1].nbytes
    return Shard(terminals, parts[0].reshape(-1, 2), *parts[1:])


class Writer:
    """Writes documents to a file, shard by shard."""

    def __init__(self, stream, terminals: int, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT):
        self.stream, self.terminals, self.shard_ids, self.min_count = stream, terminals, shard_ids, min_count
        self.held, self.docs, self.size = [], [], 0
        self.table, self.at, self.n_ids, self.n_docs = [], len(MAGIC), 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        done = 0
        while done < len(ids):
            part = ids[done:done + self.shard_ids - self.size]
            flags = (HAS_ID if doc_id is not None else 0) | (BEGINS if not done else 0)
            done += len(part)
            self.held.append(part)
            self.docs.append((doc_id, len(part), flags | (ENDS if done == len(ids) else 0)))
            self.size += len(part)
            if self.size >= self.shard_ids:
                self.flush()
        self.n_docs += 1

    def flush(self) -> None:
        if not self.docs:
            return
        data = pack_shard(np.concatenate(self.held), self.terminals, self.docs, self.min_count)
        self.stream.write(data)
        self.table.append((self.at, self.n_ids, self.size, len(self.docs)))
        self.at, self.n_ids = self.at + len(data), self.n_ids + self.size
        self.held, self.docs, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        for entry in self.table:
            self.stream.write(ENTRY.pack(*entry))
        self.stream.write(TAIL.pack(self.at, len(self.table)) + MAGIC)
        self.stream.close()


def read_table(stream) -> list[tuple[int, int, int, int, int]]:
    """(offset, bytes, ids before, ids, documents) of each shard of a file."""
    size = stream.size()
    stream.seek(size - TAIL.size - len(MAGIC))
    tail = stream.read(TAIL.size + len(MAGIC))
    if tail[TAIL.size:] != MAGIC:
        raise ValueError("not a file of grammar-compressed ids")
    at, n = TAIL.unpack_from(tail)
    stream.seek(at)
    data = stream.read(ENTRY.size * n)
    rows = [ENTRY.unpack_from(data, ENTRY.size * k) for k in range(n)]
    ends = [r[0] for r in rows[1:]] + [at]
    return [(r[0], end - r[0], *r[1:]) for r, end in zip(rows, ends, strict=True)]


def _shard_at(stream, offset: int, size: int) -> Shard:
    stream.seek(offset)
    return unpack_shard(stream.read(size))


def read_documents(stream) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start in the file, ids, crc32 of the ids) of each document of a file."""
    doc_id, start, n, crc = None, 0, 0, 0
    for offset, size, before, _, _ in read_table(stream):
        shard = _shard_at(stream, offset, size)
        ids, at = shard.ids(), 0
        for i, count, flags in zip(shard.doc_ids.tolist(), shard.doc_counts.tolist(), shard.flags.tolist(), strict=True):
            if flags & BEGINS:
                doc_id, start, n, crc = i if flags & HAS_ID else None, before + at, 0, 0
            crc = zlib.crc32(ids[at:at + count], crc)
            n, at = n + count, at + count
            if flags & ENDS:
                yield doc_id, start, n, crc


def read_range(stream, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a file, from the shards that hold them."""
    out = [_shard_at(stream, offset, size).ids(max(start - before, 0), min(start + n, before + count) - max(start, before))
           for offset, size, before, count, _ in read_table(stream) if before < start + n and start < before + count]
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                end_id: int = END_ID, shard_ids: int = SHARD_IDS, part_bytes: int = PART_BYTES, min_count: int = MIN_COUNT) -> DataFrame:
    """Write the files below ``folder``; returns the manifest: ``part`` (ascending with
    the documents' ids), ``path``, ``docs``, ``ids``, ``bytes``, ``before`` (ids of all files before)."""
    spark = docs.sparkSession
    ship_package(spark)
    path = path or vocabulary_path()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(-(-size // part_bytes), spark.sparkContext.defaultParallelism)
    ordered = (given.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie")
               .sortWithinPartitions("id", "tie", "text"))
    out = schema(part=INT, path=STRING, docs=LONG, ids=LONG, bytes=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, end, name = encoder(path), None, np.array([end_id], dtype="<u4"), ""
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.ids"
                    writer = Writer(open_file(name, write=True), max(encode.size, end_id + 1), shard_ids, min_count)
                writer.add(i, np.concatenate([encode.ids(text.as_py()), end]))
        if writer is not None:
            writer.close()
            row = (TaskContext.get().partitionId(), name, writer.n_docs, writer.n_ids, writer.at)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], out.names)

    files, _ = materialise(ordered.mapInArrow(run, out), "manifest")
    # one row a file: small enough for a running sum
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", before)


def read_files(manifest: DataFrame) -> DataFrame:
    """A row per document of the manifest's files, from the files: ``doc_id``, ``start``
    (ids of all documents before), ``n_tokens``, ``ids_crc32``."""
    spark = manifest.sparkSession
    ship_package(spark)
    out = schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with open_file(path) as stream:
                    rows = []
                    for i, start, n, crc in read_documents(stream):
                        rows.append((i, before + start, n, crc))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], out.names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], out.names)

    return _one_file_a_task(manifest).mapInArrow(run, out)


def _one_file_a_task(manifest: DataFrame) -> DataFrame:
    """The manifest's files over as many partitions, in turn."""
    spark = manifest.sparkSession
    kept, _ = materialise(manifest, "files")
    return kept.repartition(max(kept.count(), 1))


def read_ranges(manifest: DataFrame, ranges: DataFrame, start_col: str = "start", n_col: str = "n_tokens") -> DataFrame:
    """Random access: the rows of ``ranges`` with ``ids`` (binary, little-endian uint32),
    the ids ``start`` to ``start + n`` of the whole corpus. A range over several files
    is a row for each, with ``part`` and ``ids`` from it. Only the shards and symbols over a range are read."""
    ship_package(manifest.sparkSession)
    names = ranges.columns
    out = T.StructType([*ranges.schema.fields, T.StructField("part", INT), T.StructField("ids", BINARY)])
    wanted = ranges.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names)),
                           F.col(f"`{start_col}`").cast("long").alias("_from"), F.col(f"`{n_col}`").cast("long").alias("_n"))
    files = manifest.select("part", "path", "before", "ids")
    found = wanted.join(files, (F.col("before") < F.col("_from") + F.col("_n")) & (F.col("_from") < F.col("before") + F.col("ids")))
    found = found.repartition("path").sortWithinPartitions("path", "_from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, path, stream = [], None, None
            for p, before, size, start, n in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "ids", "_from", "_n")), strict=True):
                if p != path:
                    if stream:
                        stream.close()
                    path, stream = p, open_file(p)
                low = max(start, before)
                got.append(read_range(stream, low - before, min(start + n, before + size) - low).tobytes())
            if stream:
                stream.close()
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{k}") for k in range(len(names))), batch.column("part"),
                                              pa.array(got, pa.binary())], out.names)

    return found.mapInArrow(run, out)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as grammar-compressed ids in id order and read back."""
    return read_files(write_files(documents(spark, sf_dir), scratch_path(spark, "ids")))
