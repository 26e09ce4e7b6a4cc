"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

Documents are dealt into ranges of ascending doc_id. Each task encodes its range and writes three files:
`part-N.ids` (unsigned integers, little-endian, of the manifest's width), `part-N.off` (64-bit: ids
before each document of the part, then their total) and `part-N.doc` (64-bit doc_id, its null mask in
`part-N.nul`). Where a part begins in the whole corpus is the prefix sum of the parts' totals, held in
`manifest.json` with one entry a part. A retried task writes the same bytes to a name of its own and
then renames, so a lost executor leaves nothing half written.

Where a tokenizer's rules are known never to look across a space or a newline, each distinct word of a
batch is encoded once and remembered, and the documents' ids are gathered by word; with any other rules
whole texts are encoded. The tokenizer's file (a few MB) is read on the driver and sent along.

Edge cases: a null text is empty (its end id alone); a null doc_id sorts first; rows that share a doc_id
are ordered by text; an empty table gives a manifest without parts; extra columns are not written, so
their names may be any. A text of any length is encoded whole: one batch, and the ids of one document
when read, must fit a worker.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, open_fs, shuffle_width, worker_runs
from lodestone.llm.wordhash import blocks, gather, hash_strings, string_buffers

#: Texts' words whose ids a worker remembers: some 20 MB. Past this those not met again are forgotten; ids don't depend on it.
CACHE_WORDS = 500_000
#: Bytes of text encoded at once, and ids read at once, where documents are not longer; words given to the tokenizer at once.
TEXT_BYTES = 1 << 20
READ_IDS = 1 << 20
WORDS_AT_ONCE = 2000
#: Documents in an Arrow batch.
TEXT_ROWS = 500

#: Parts of a tokenizer's rules that treat what a space parts as apart.
_NORMALIZERS = frozenset(["NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"])
#: A split pattern of alternatives none of which can hold white space: letters behind an apostrophe, runs of a class, runs of anything but white space.
_ALTERNATIVE = r"(?:'[a-z]+|\[\\p\{[A-Z][a-z]?\}\]\+?|\\p\{[A-Z][a-z]?\}\+?|\[\^\\s[^\[\]]*\]\+?|\\S\+?)"
_SPACELESS = re.compile(rf"{_ALTERNATIVE}(?:\|{_ALTERNATIVE})*")

_loaded: dict = {}


def _parts(rule: dict | None, inner: str) -> list[dict]:
    if rule is None:
        return []
    return [x for part in rule[inner] for x in _parts(part, inner)] if rule.get("type") == "Sequence" else [rule]


def words_stand_alone(rules: dict) -> bool:
    """Whether a text's ids are those of its words, where spaces and newlines part words, one after another."""
    for x in _parts(rules.get("normalizer"), "normalizers"):
        to_space = x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "
        if x["type"] not in _NORMALIZERS and not to_space:
            return False
    splits = _parts(rules.get("pre_tokenizer"), "pretokenizers")
    if not splits:
        return False
    first = splits[0]
    drops = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    if first["type"] == "Split":
        drops = first["behavior"] == "Removed" and first["invert"] and bool(_SPACELESS.fullmatch(first["pattern"].get("Regex", "")))
    later = all(x["type"] in ("Digits", "Punctuation", "Whitespace", "WhitespaceSplit", "BertPreTokenizer") or x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in splits[1:])
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and x["content"].split() == [x["content"]] for x in rules.get("added_tokens") or [])
    cut_short = rules.get("truncation") is not None or rules.get("padding") is not None
    return drops and later and added and not cut_short and not rules["model"].get("dropout")


class _Run:
    """Words in the order of their hashes, with their bytes and ids, and whether they were met again."""

    def __init__(self, h: np.ndarray, words: tuple, ids: tuple, again: np.ndarray | None = None):
        by = np.argsort(h, kind="stable")
        self.h, self.again = h[by], np.zeros(len(h), bool) if again is None else again[by]
        self.words, self.ids = ((flat, begin[by].astype(np.int32), size[by].astype(np.int32)) for flat, begin, size in (words, ids))

    def __len__(self) -> int:
        return len(self.h)

    def __add__(self, other: _Run) -> _Run:
        both = ((np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1] + len(x[0]))), np.concatenate((x[2], y[2]))) for x, y in ((self.words, other.words), (self.ids, other.ids)))
        return _Run(np.concatenate((self.h, other.h)), *both, np.concatenate((self.again, other.again)))

    def met_again(self) -> _Run:
        """The words that were found since the last such call."""
        keep = np.flatnonzero(self.again)
        both = ((gather(flat, begin[keep], (n := size[keep]).astype(np.int64)), np.cumsum(n) - n, n) for flat, begin, size in (self.words, self.ids))
        return _Run(self.h[keep], *both)

    def find(self, h: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are here, compared byte by byte, and where."""
        at = np.minimum(np.searchsorted(self.h, h), len(self) - 1)
        may = np.flatnonzero((self.h[at] == h) & (self.words[2][at] == words[2]))
        at, size = at[may], words[2][may].astype(np.int64)
        other = gather(words[0], words[1][may], size) != gather(self.words[0], self.words[1][at], size)
        wrong = np.concatenate(([0], np.cumsum(other)))
        end = np.cumsum(size)
        same = wrong[end] == wrong[end - size]
        self.again[at[same]] = True
        return may[same], at[same]


class Encoder:
    """Ids of whole texts, by their words where the rules allow it."""

    def __init__(self, rules: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(rules)
        self.by_word = words_stand_alone(json.loads(rules))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.runs: list[_Run] = []

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has, by the tokenizer."""
        flat, size = [], []
        for a in range(0, len(texts), WORDS_AT_ONCE):
            part = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + WORDS_AT_ONCE], add_special_tokens=False)]
            size.append(np.fromiter(map(len, part), np.int64, len(part)))
            flat.append(np.fromiter(chain.from_iterable(part), self.kind, int(size[-1].sum())))
        return (np.concatenate(flat), np.concatenate(size)) if flat else (np.zeros(0, self.kind), np.zeros(0, np.int64))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids, where each word's begin, and how many it has."""
        buf, off = string_buffers(words)
        own = (buf, off[:-1], np.diff(off))
        with np.errstate(over="ignore"):
            h = hash_strings(buf, off)
        begin, size, flat = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), []
        base = 0
        left = np.arange(len(words))
        for run in self.runs:
            hit, at = run.find(h[left], (buf, own[1][left], own[2][left]))
            n = run.ids[2][at].astype(np.int64)
            begin[left[hit]], size[left[hit]] = base + np.cumsum(n) - n, n
            flat.append(gather(run.ids[0], run.ids[1][at], n))
            base += len(flat[-1])
            left = np.delete(left, hit)
        if len(left):
            ids, n = self._ids(words.take(pa.array(left)).to_pylist())
            begin[left], size[left] = base + np.cumsum(n) - n, n
            flat.append(ids)
            bytes_ = gather(buf, own[1][left], own[2][left])
            self.runs.append(_Run(h[left], (bytes_, np.cumsum(own[2][left]) - own[2][left], own[2][left]), (ids, np.cumsum(n) - n, n)))
            if sum(map(len, self.runs)) > CACHE_WORDS:
                self.runs = [r for r in (r.met_again() for r in self.runs[:-1]) if len(r)] + self.runs[-1:]
            while len(self.runs) > 1 and 2 * len(self.runs[-1]) >= len(self.runs[-2]):
                self.runs[-2:] = [self.runs[-2] + self.runs[-1]]
            while sum(map(len, self.runs)) > CACHE_WORDS:
                self.runs.pop(0)
        return np.concatenate(flat or [np.zeros(0, self.kind)]), begin, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        texts = texts.fill_null("")
        if self.by_word:
            split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
            coded = pc.dictionary_encode(split.flatten())
            flat, begin, n = self._words(coded.dictionary)
            word, words = coded.indices.to_numpy(), np.diff(np.asarray(split.offsets))
        else:
            flat, n = self._ids(texts.to_pylist())
            begin, word, words = np.cumsum(n) - n, np.arange(len(texts)), np.ones(len(texts), np.int64)
        # the end id stands as a word of its own behind the words of each text
        flat, begin, n = np.append(flat, np.array(end_id, self.kind)), np.append(begin, len(flat)), np.append(n, 1)
        word = np.insert(word, np.cumsum(words), len(n) - 1)
        upto = np.concatenate(([0], np.cumsum(n[word])))
        return gather(flat, begin[word], n[word]), np.diff(upto[np.concatenate(([0], np.cumsum(words + 1)))])


def _give_back() -> None:
    """From now on arrays of a megabyte go back to the machine when they are dropped: the C library else keeps ever larger ones."""
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def encoder(rules: str) -> Encoder:
    key = zlib.crc32(rules.encode()), len(rules)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(rules)
    return _loaded[key]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> dict:
    """Writes docs under path and returns the manifest. tokenizer: a file of the driver's."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        rules = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(parts or shuffle_width(spark), F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), F.col("t").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = open_fs(path)
        name, own = f"{root}/part-{task.partitionId():06d}", uuid.uuid4().hex
        worker_runs("tokens", _loaded.clear)
        _give_back()
        enc = encoder(rules.value)
        off, ids, nulls, total = [np.zeros(1, np.int64)], [], [], 0
        out = None
        for batch in batches:
            for a, b in blocks(string_buffers(batch.column(1))[1], TEXT_BYTES):
                part = batch.slice(a, b - a)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.ids.{own}")
                coded, n = enc.encode(part.column(1), end_id)
                out.write(coded.tobytes())
                ends = total + np.cumsum(n)
                total = int(ends[-1])
                off.append(ends)
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out is None:
            return
        out.close()
        for end, data in (("off", np.concatenate(off).astype("<i8")), ("doc", np.concatenate(ids).astype("<i8")), ("nul", np.concatenate(nulls))):
            with fs.open_output_stream(f"{name}.{end}.{own}") as f:
                f.write(data.tobytes())
        for end in ("ids", "off", "doc", "nul"):
            fs.move(f"{name}.{end}.{own}", f"{name}.{end}")
        n = int(sum(map(len, ids)))
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "docs": [n], "tokens": [total], "width": [enc.width]})

    with arrow_rows(spark, TEXT_ROWS):
        done = sorted(rows.mapInArrow(write, "part long, docs long, tokens long, width long").collect())  # one row a part
    manifest: dict = {"width": done[0].width if done else 2, "end_id": end_id, "parts": []}
    base = before = 0
    for r in done:
        manifest["parts"].append({"part": r.part, "docs": r.docs, "tokens": r.tokens, "base": base, "first_doc": before})
        base, before = base + r.tokens, before + r.docs
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class _File:
    """A flat file as an array: mapped on a file system, read a slice at a time elsewhere."""

    def __init__(self, fs: pafs.FileSystem, file: str, kind: str):
        self.kind, self.size = np.dtype(kind), fs.get_file_info(file).size
        if not self.size:
            self.data = np.zeros(0, self.kind)
        elif isinstance(fs, pafs.LocalFileSystem):
            self.data = np.memmap(file, dtype=self.kind, mode="r")
        else:
            self.data, self.file = None, fs.open_input_file(file)

    def __len__(self) -> int:
        return self.size // self.kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.data is not None:
            return self.data[part]
        a, b, _ = part.indices(len(self))
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at(max(b - a, 0) * w, a * w), self.kind)


def part_arrays(path: str, part: int, width: int) -> tuple[_File, _File, _File, _File]:
    """ids, offsets, doc_ids and null mask of a part."""
    fs, root = open_fs(path)
    name = f"{root}/part-{part:06d}"
    return tuple(_File(fs, f"{name}.{end}", kind) for end, kind in (("ids", f"<u{width}"), ("off", "<i8"), ("doc", "<i8"), ("nul", "u1")))


def read_tokens(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of 32-bit ids), and the ids if asked for."""
    fs, root = open_fs(path)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    width = manifest["width"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    parts = spark.createDataFrame([(p["part"], p["base"]) for p in manifest["parts"]], "part long, base long").repartition(max(1, len(manifest["parts"])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                data, off, doc, nul = part_arrays(path, part, width)
                a = 0
                while a < len(doc):
                    near = np.asarray(off[a : a + 5001])
                    cuts = near[: max(2, int(np.searchsorted(near, near[0] + READ_IDS, side="right")))]
                    b = a + len(cuts) - 1
                    own = data[int(cuts[0]) : int(cuts[-1])].astype("<u4")
                    at = cuts - cuts[0]
                    cols = [
                        pa.array(np.asarray(doc[a:b]), mask=np.asarray(nul[a:b]).astype(bool)),
                        pa.array(cuts[:-1] + base),
                        pa.array(np.diff(cuts)),
                        pa.array([zlib.crc32(own[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    ]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    a = b

    return parts.mapInArrow(read, schema)
