"""Token-ID output: flat unsigned integer files with 64-bit document offsets, and a memory-mapped reader."""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import binary_column, file_system, materialize, publish, shared_dir

#: Bytes of text that are encoded together, and entries of a worker's cache of pieces (about 200 bytes each).
SLICE_BYTES, CACHE_ENTRIES = 2 << 20, 1_000_000
#: Pieces that go to the library in one call.
JOINED = 4000

#: Latin-1 bytes of ASCII characters and letters that are their own composed form and have one lower-case letter, and their lower case.
_LATIN = bytes(c for c in range(256) if c < 128 or c >= 0xC0 and c not in (0xD7, 0xF7))
_LATIN_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: Pieces of lower-cased Latin-1 text, by the split pattern that the public word-level tokenizer file states.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xc0-\xff]+")


#: The steps of the public word-level tokenizer file that _PIECES follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def splits_into_words(path: str) -> bool:
    """Whether the tokenizer file's steps are the ones that _PIECES follows in all their settings: it drops white space, lower-cases, splits by
    that pattern, marks word ends, cuts nothing off, merges without chance, and its added tokens all start with what sends a text to the library."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    plain = all(rules.get(k) is None for k in ("truncation", "padding", "post_processor")) and not model.get("dropout") and model.get("continuing_subword_prefix") is None
    return plain and rules.get("normalizer") == _NORMALIZER and rules.get("pre_tokenizer") == _PRE_TOKENIZER and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in rules.get("added_tokens") or [])


class WordEncoder:
    """Encodes texts by the library, each distinct piece of a word-level tokenizer once.

    The tokenizer's own pre-tokenizer works on pieces that white space or the kind of character ends, so a text's ids are those of its
    pieces in order. Texts (else white-space separated words) of ASCII and plain Latin-1 letters are cut into
    pieces here; everything else, and any word with the opening of a special token, goes to the library as it is. New pieces are encoded by the thousand in
    one call, and told apart by the tokens that end a word. For any other tokenizer, whole texts go to the library.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.library, self.dtype, self.by_word = Tokenizer.from_file(path), np.dtype(dtype), splits_into_words(path)
        self.cache: dict[bytes, bytes] = {}  # of pieces in Latin-1
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[bytes]) -> None:
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache.clear()
        for at in range(0, len(missing), JOINED):
            part = missing[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast([b" ".join(part).decode("latin-1")], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, bounds = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
                self.cache.update(zip(part, (raw[a:b] for a, b in zip([0, *bounds], bounds, strict=False)), strict=True))
            else:
                self.cache.update(zip(part, self._encode([x.decode("latin-1") for x in part]), strict=True))

    @staticmethod
    def _pieces(text: bytes) -> list[bytes] | None:
        """Pieces of plain text in UTF-8, or None if the library has to cut it."""
        if b"<|" in text:
            return None
        if not text.isascii():
            try:
                text = text.decode().encode("latin-1")
            except UnicodeError:
                return None
            if text.translate(None, _LATIN):
                return None
        return _PIECES.findall(text.translate(_LATIN_LOWER))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Token ids of each text (UTF-8) as little-endian integers of the dtype."""
        if not self.by_word:
            return self._encode([t.decode("utf-8", "replace") for t in texts])
        cut: list[tuple[bool, list]] = []  # whether all are pieces, and the pieces, or words as pieces or as they are
        seen: set[bytes] = set()
        other: set[bytes] = set()
        for t in texts:
            pieces = self._pieces(t)
            if pieces is None:  # word by word
                words = [(w, self._pieces(w)) for w in t.split()]
                other.update(w for w, p in words if p is None)
                cut.append((False, [w if p is None else p for w, p in words]))
                seen.update(x for _, p in words if p for x in p)
            else:
                cut.append((True, pieces))
                seen.update(pieces)
        if missing := seen.difference(self.cache):
            if len(self.cache) + len(missing) > CACHE_ENTRIES:
                missing = seen  # the cache is about to be emptied
            self._learn(sorted(missing))
        get, rest = self.cache.__getitem__, dict(zip(other, self._encode([w.decode("utf-8", "replace") for w in other]), strict=True))
        out = []
        for plain, parts in cut:
            out.append(b"".join(map(get, parts)) if plain else b"".join([b"".join(map(get, x)) if isinstance(x, list) else rest[x] for x in parts]))
        return out


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def _encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def _slices(texts: Iterable[bytes], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class TokenFiles:
    """A folder of token files. index.json names the parts in id order with their bases.

    <part>.ids: token ids of all documents, end id included, as unsigned integers of `dtype`.
    <part>.off: n + 1 unsigned 64-bit offsets, in ids from the part's start; a document's place in the whole is base + offset.
    <part>.doc: n signed 64-bit document ids (a null id is the least value).
    """

    folder: str
    dtype: str
    parts: tuple[tuple[str, int, int, int], ...]  # name, documents, tokens, base

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        system, path = file_system(f"{folder}/index.json")
        with system.open_input_file(path) as f:
            index = json.loads(f.read())
        return cls(folder, index["dtype"], tuple(map(tuple, index["parts"])))


NULL_ID = -(1 << 63)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> TokenFiles:
    """Encode docs in ascending id order into token files of one part per partition.

    Every document is its text's ids (none for a null, empty or blank text) and then end_id. Repeated ids stay, ordered by
    text hash; null ids come first. An empty table gives no parts. Other columns are ignored. Ids are 16 bits wide where
    the vocabulary and end_id fit, else 32.

    Documents are dealt out by ranges of (id, text hash), so a repeated id can't fill a partition, and a part is
    written as a stream. Files have names of their own for each attempt; a lost or repeated task leaves files that no
    manifest names. The driver only sees the manifest, one row a part, whose prefix sums are the parts' bases.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange(count, "id", "h").sortWithinPartitions("id", "h")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder, end = _encoder(tokenizer_path, dtype), np.array([end_id], dtype=dtype).tobytes()
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        system, path = file_system(f"{folder}/{name}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        total = docs_here = 0
        with system.open_output_stream(f"{path}.ids") as ids, system.open_output_stream(f"{path}.off") as off, system.open_output_stream(f"{path}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for batch in itertools.chain([first], batches):
                doc.write(batch.column("id").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for texts in _slices(x.as_py() for x in binary_column(batch, "text")):
                    coded = encoder.encode(texts)
                    lengths = np.array([len(c) // len(end) + 1 for c in coded], dtype="<u8")
                    off.write((total + np.cumsum(lengths, dtype="<u8")).astype("<u8").tobytes())
                    ids.write(b"".join([x for c in coded for x in (c, end)]))
                    total += int(lengths.sum())
                    docs_here += len(coded)
        yield pa.RecordBatch.from_pydict({"name": [name], "docs": [docs_here], "tokens": [total]})

    manifest = materialize(ordered.mapInArrow(run, "name string, docs long, tokens long"), "token-manifest")
    parts, base = [], 0
    for r in sorted(manifest.collect()):
        parts.append((r.name, r.docs, r.tokens, base))
        base += r.tokens
    publish(f"{folder}/index.json", lambda f: f.write(json.dumps({"dtype": dtype, "end_id": end_id, "tokens": base, "parts": parts}).encode()))
    return TokenFiles(folder, dtype, tuple(parts))


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped into memory where the file system is local, else read."""
    from pyarrow import fs

    system, path = file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of each document: start counts the ids of all documents before it, and ids_crc32 is the
    CRC-32 of its ids as little-endian 32-bit integers. The parts are read by as many tasks."""
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not files.parts:
        return spark.createDataFrame([], schema)
    folder, dtype = files.folder, files.dtype
    parts = spark.createDataFrame([(n, d, b) for n, d, _, b in files.parts], "name string, docs long, base long").repartition(len(files.parts))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batch.to_pylist():
                uri = f"{folder}/{part['name']}"
                ids, off, doc = _mapped(f"{uri}.ids", dtype), _mapped(f"{uri}.off", "<u8"), _mapped(f"{uri}.doc", "<i8")
                for at in range(0, part["docs"], 1000):
                    o = off[at : at + 1001].astype(np.int64)
                    own = [np.asarray(ids[a:b], dtype="<u4") for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    d = np.asarray(doc[at : at + 1000])
                    cols = {"id": pa.array(d, mask=d == NULL_ID), "start": o[:-1] + part["base"], "n_tokens": np.diff(o), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    return parts.mapInArrow(run, schema)
