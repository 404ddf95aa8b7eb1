"""Token ids in binary shards with Elias-Fano document boundaries.

A shard is one byte string: a header, the documents' ids, the ends of the documents as an Elias-Fano
sequence over the concatenated token ids, and the token ids themselves, two bytes each where the
vocabulary allows. ``Shard`` reads one; ``select`` gives one document's offsets without a 64-bit table.

Documents are range-partitioned and sorted by id, so shards are in ascending order by (part, seq).
Shards are written by Spark as rows of a Parquet table in shared storage: only whole, committed tasks
are seen, a lost executor's shards are written again, and no executor needs a local folder.
``save_files`` copies the shards to plain files where a folder is mounted.

Where the tokenizer's file says that it normalizes and splits as BY_WORD (read from the file, never
assumed), words between ASCII white space are encoded one by one and remembered: such a tokenizer never
joins across white space, so a text's ids are its words' ids. The memory is bounded (MEMORY words). With
any other tokenizer, whole texts go through the library.

Defined cases: a null or empty text is the end id alone. Rows with equal ids follow each other in the
order of their texts' hashes, rows with a null id come first. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.elias_fano import EliasFano, encode
from tripleweave.llm.scratch import new_path
from tripleweave.llm.textmap import arrow_map, pieces
from tripleweave.llm.wordhash import Words, byte_values, mixed

MAGIC, VERSION = b"TKS1", 1
_HEAD = struct.Struct("<4sBBxxIQQ")
#: Token ids in a shard: it ends with the document that reaches this many.
SHARD_IDS = 2 << 20
#: Words, and parts of words, whose ids a worker remembers.
MEMORY, PARTS = 600_000, 120_000
#: Bytes of text encoded at once: what is new in them is sorted into what is known.
PIECE_BYTES = 1 << 20
_LEADING, _TOGETHER = 18, 64
_VALUES = byte_values(bytes(b for b in range(256) if b not in b" \t\n\v\f\r"), fold_case=False)
END_ID = 2


#: What a tokenizer's file must say for its words to be encoded one by one.
BY_WORD = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_MODEL = {"type": "BPE", "dropout": None, "end_of_word_suffix": "</w>"}


def splits_by_word(path: str) -> bool:
    """Whether the file's tokenizer treats words between white space each on its own, as :func:`_parts` expects."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    tokens = said.get("added_tokens") or []
    plain = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and len(t["content"].split()) == 1 for t in tokens)
    return plain and all(said.get(k) == v for k, v in BY_WORD.items()) and all(said["model"].get(k) == v for k, v in _MODEL.items())


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def _parts(word: bytes) -> tuple[str, str]:
    """A word as what is remembered of it: in lower case, without the punctuation at its end, and that.

    Only where the tokenizer treats both alike: up to U+00FF a character's lower case is one character
    and nothing composes, and its pattern always cuts between a letter or digit and other signs, but
    for an apostrophe. Else the word stays as it is.
    """
    core = word.rstrip(_PUNCTUATION)
    if core.isalnum():  # ASCII
        return core.lower().decode(), word[len(core) :].decode()
    text = word.decode("utf-8", "replace")
    if b"'" in word or b"<|" in word or max(text) > "\xff":
        return text, ""
    core = core.decode("utf-8", "replace")
    if not core or not (core[-1].isalpha() or core[-1] in "0123456789") or core[-1] in "\xaa\xb5\xba":
        return text.lower(), ""
    return core.lower(), text[len(core) :]


class Encoder:
    """Encodes texts, word by word where the tokenizer allows it. Words are looked up by hash, length and first bytes in arrays, so a word that is known costs no Python work. Once MEMORY words and PARTS parts are known, others are encoded anew in each batch."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_word = Tokenizer.from_file(path), end_id, splits_by_word(path)
        self.wide = max(self.tokenizer.get_vocab_size(True) - 1, end_id) > 0xFFFF
        #: Ids of tokens that end a letter run, if the vocabulary tells.
        self.last = np.zeros(self.tokenizer.get_vocab_size(True), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(True).items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {"": b""}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: Known words by hash: the hashes in order, what else must agree, and the word's number; where each value of the leading bits begins.
        self.hashes, self.checks, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.index = np.zeros((1 << _LEADING) + 1, np.int32)

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        split = [_parts(w) for w in words]
        new = [p for p in dict.fromkeys(p for x in split for p in x) if p not in self.parts]
        got = self._ids_of(new)
        of = self.parts
        if len(of) + len(new) <= PARTS:
            of.update(zip(new, got))
        else:
            of = ChainMap(dict(zip(new, got)), of)
        return [of[a] + of[b] if b else of[a] for a, b in split]

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Parts that are one letter run each are encoded many at a time: each ends with an id that only ends a run."""
        runs = [i for i, p in enumerate(parts) if p.isalpha() and max(p) <= "\xff"]
        out: list[bytes | None] = [None] * len(parts)
        if runs:
            texts = [" ".join(parts[i] for i in runs[a : a + _TOGETHER]) for a in range(0, len(runs), _TOGETHER)]
            ids = np.fromiter((i for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids), "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(runs) and ends[-1] == len(ids):
                data, bounds = ids.tobytes(), (4 * np.concatenate([[0], ends])).tolist()
                for i, a, b in zip(runs, bounds, bounds[1:]):
                    out[i] = data[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
                out[i] = np.array(x.ids, "<u4").tobytes()
        return out

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The numbers of known words, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        lead = (h >> np.uint64(64 - _LEADING)).astype(np.int64)
        at, end = self.index[lead], self.index[lead + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = (self.hashes[at] == h[open_]) & (self.checks[at] == check[open_])
            out[open_[hit]] = self.slots[at[hit]]
            at += 1
            more = ~hit & (at < end)
            open_, at, end = open_[more], at[more], end[more]
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text's, and the number of each text's ids."""
        if not self.by_word:
            whole = self.tokenizer.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            ids = [np.array([*x.ids, self.end], np.uint32) for x in whole]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        words = Words(texts, _VALUES)
        h, check = words.hashes, _checks(words)
        which = self._find(h, check)
        missing = np.flatnonzero(which < 0)
        flat, starts, lengths = self.flat, self.starts, self.lengths
        if len(missing):
            _, first, of = np.unique(h[missing] ^ mixed(check[missing]), return_index=True, return_inverse=True)
            first = missing[first]
            ids = self._encoded([words.word(i) for i in first.tolist()])
            n = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
            which[missing] = len(starts) + of
            starts, lengths = np.concatenate([starts, len(flat) + np.cumsum(n, dtype=np.int64) - n]), np.concatenate([lengths, n])
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), "<u4")])
            if len(starts) <= MEMORY:
                slots = np.arange(len(self.starts), len(starts), dtype=np.int32)
                self.flat, self.starts, self.lengths = flat, starts, lengths
                order = np.argsort(h[first])
                at = np.searchsorted(self.hashes, h[first][order])
                self.hashes, self.checks, self.slots = (np.insert(x, at, y[order]) for x, y in ((self.hashes, h[first]), (self.checks, check[first]), (self.slots, slots)))
                self.index = np.searchsorted(self.hashes >> np.uint64(64 - _LEADING), np.arange((1 << _LEADING) + 1, dtype=np.uint64)).astype(np.int32)
        n = lengths[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[which] - total[:-1], n) + np.arange(total[-1])]
        ends = total[words.first[1:]]
        return np.insert(ids, ends, self.end), np.diff(np.concatenate([[0], ends])) + 1


def _checks(words: Words) -> np.ndarray:
    """Length and first eight bytes of each word, mixed."""
    data = np.frombuffer(words.buffer + bytes(8), np.uint8)
    length = words.ends - words.starts
    out = length.astype(np.uint64)
    for i in range(8):
        byte = data[words.starts + i].astype(np.uint64)
        byte[length <= i] = 0
        out = out * np.uint64(0xD6E8FEB86659FD93) + byte
    return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One for each worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, wide: bool) -> bytes:
    there = np.array([x is not None for x in doc_ids], bool)
    named = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.packbits(there, bitorder="little").tobytes()
    ends = encode(np.cumsum(counts))
    return _HEAD.pack(MAGIC, VERSION, 4 if wide else 2, len(ends), len(doc_ids), len(ids)) + named + ends + ids.astype("<u4" if wide else "<u2").tobytes()


class Shard:
    """Reads one shard."""

    def __init__(self, data: bytes):
        magic, version, width, n_ends, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        a = _HEAD.size
        b = a + 8 * self.n_docs
        c = b + -(-self.n_docs // 8)
        there = np.unpackbits(np.frombuffer(data, np.uint8, c - b, b), bitorder="little")[: self.n_docs]
        self.doc_ids = [x if y else None for x, y in zip(np.frombuffer(data, "<i8", self.n_docs, a).tolist(), there.tolist())]
        self.ends = EliasFano(memoryview(data)[c : c + n_ends])
        self.ids = np.frombuffer(data, "<u4" if width == 4 else "<u2", self.n_ids, c + n_ends)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def write_shards(docs: DataFrame, tokenizer: str, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the table of shards: part, seq, before (ids of the part's shards before it), n_docs, n_ids, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, make = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer, end_id)
        names, counts, ids = [], [], []

        def done() -> pa.RecordBatch:
            nonlocal seq, before, names, counts, ids
            flat = np.concatenate(ids)
            row = [part, seq, before, len(names), len(flat), shard(names, np.concatenate(counts), flat, make.wide)]
            seq, before, names, counts, ids = seq + 1, before + len(flat), [], [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["part", "seq", "before", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for rows, texts in pieces(batch, 1, PIECE_BYTES):
                got, n = make.encode(texts)
                of, i, a = rows.column(0).to_pylist(), 0, 0
                held = sum(map(len, ids))
                total = held + np.cumsum(n)
                while i < len(of):
                    j = min(len(of), i + 1 + int(np.searchsorted(total[i:], shard_ids)))
                    b = a + int(n[i:j].sum())
                    names += of[i:j]
                    counts.append(n[i:j])
                    ids.append(got[a:b])
                    if total[j - 1] >= shard_ids:
                        yield done()
                        total = total - total[j - 1]
                    i, a = j, b
        if names:
            yield done()

    rows = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    sorted_rows = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "t").select("d", "t")
    shards = arrow_map(sorted_rows, run, "part int, seq int, before long, n_docs long, n_ids long, payload binary")
    shards.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, from the shards alone.

    What goes to the driver and is broadcast is one number for each part, of which there are as many as
    the writing shuffle had partitions.
    """
    shards = spark.read.parquet(path)
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, base = {}, 0
    for part, n in sums:
        bases[part] = base
        base += n
    sent = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = Shard(payload)
                ends = x.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(x.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.doc_ids, pa.int64()), pa.array(starts + sent.value[part] + before), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return arrow_map(shards.select("part", "before", "payload"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the shards to the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer, path, **options)
    return read_shards(docs.sparkSession, path)


def save_files(spark, path: str, folder: str) -> int:
    """Copies the shards of a table to files in a mounted folder, named in ascending order; returns how many."""
    n = 0
    for row in spark.read.parquet(path).orderBy("part", "seq").select("payload").toLocalIterator():
        with open(os.path.join(folder, f"shard-{n:06d}.tks"), "wb") as f:
            f.write(row.payload)
        n += 1
    return n
