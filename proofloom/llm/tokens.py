"""Token ids of whole texts with a public tokenizer: files of equal-length sequences, and counts by section.

A byte-level vocabulary with GPT-2's pattern splits texts into short words first and merges bytes within words only. So a batch is split
here, its distinct words go to the tokenizers library, and the ids are dealt back: the same ids as for whole texts, several times sooner.
(``tests`` hold both against each other.) A vocabulary file that says anything else of its normalizer, pre-tokenizer or added tokens gets
the whole texts. Vocabulary files stay where they are; their path is a parameter.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from proofloom.llm import words
from proofloom.llm.shared import cut, file_system, find_package, new_folder

_LETTER, _NUMBER, _SPACE = 1, 2, 3
#: White space as the vocabulary's pattern takes it.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _classes() -> np.ndarray:
    """Of each code point whether it is a letter, a number, white space or something else (0)."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    place = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            out[place[m.start() : m.end()]] = kind
    out[_WHITE] = _SPACE
    return out


def word_starts(data: np.ndarray, off: np.ndarray, special: tuple[bytes, ...] = ()) -> np.ndarray:
    """Byte positions where the words of GPT-2's pattern begin; rows and special tokens are split apart first.

    The pattern: 's 't 're 've 'm 'll 'd, or an optional blank with a run of letters, numbers or other signs, or white space, of which the last
    character before something else is left to it.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return at
    text = data.tobytes() if special else b""
    marks = []
    for s in special:
        i = text.find(s)
        while i >= 0:
            marks.append((i, i + len(s)))
            i = text.find(s, i + len(s))
    cuts = np.searchsorted(at, np.concatenate((off, np.array(marks, np.int64).ravel())))
    apart = np.zeros(n + 1, bool)
    apart[cuts] = True
    kind = _classes()[cp]
    run = np.ones(n, bool)
    run[1:] = (kind[1:] != kind[:-1]) | apart[1:n]
    begins = run & (kind == _SPACE)
    other = np.flatnonzero(run & (kind != _SPACE))
    follows = ~apart[other] & (kind[other - 1] == _SPACE)
    begins[other[follows] - 1] = True
    begins[other] = ~(follows & (cp[other - 1] == 32))
    # An apostrophe that begins a word takes the letters of a contraction with it.
    quote = np.flatnonzero((cp == 39) & run & begins)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~apart[quote + 1]]
    one = cp[quote + 1]
    two = np.where((quote + 2 < n) & ~run[np.minimum(quote + 2, n - 1)], cp[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begins[quote[short | long] + 1] = False
    for which, length in ((short, 2), (long, 3)):
        after = quote[which] + length
        begins[after[after < n]] = True
    for a, b in np.searchsorted(at, np.array(marks, np.int64).reshape(-1, 2)).tolist():
        begins[a:b] = False
        begins[a] = True
    return at[begins]


def splits_by_word(said: dict) -> bool:
    """Whether a vocabulary file describes byte-level words of GPT-2's pattern, merged each by itself, as ``word_starts`` finds them."""
    pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    own = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    added = said.get("added_tokens") or []
    marks = not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")) and not any(t.get("normalized") and said.get("normalizer") for t in added)
    return bool(plain and own and marks and not said.get("normalizer") and not said.get("truncation") and not said.get("padding"))


class Encoder:
    """Ids of texts by a byte-level vocabulary file of the tokenizers library, without special tokens added."""

    #: Words remembered from batch to batch, words that the library takes at a time, and bytes of a batch.
    remembered = 400_000
    encoded = 8192
    batch_bytes = 2 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_by_word(json.loads(self.tokenizer.to_str()))
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character of a token stands for a byte
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.first, self.count, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def _known(self, distinct: pa.Array) -> np.ndarray:
        """The place of each word among the remembered ones; new words are encoded by the library."""
        if len(self.words) > self.remembered:
            self._forget()
        place = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(place.is_null())
        if not len(new):
            return place.to_numpy()
        counts, ids = [], []
        for i in range(0, len(new), self.encoded):
            some = new.slice(i, self.encoded).to_pylist()
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(e.ids, np.int64))
        count = np.concatenate(counts)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.ids = np.concatenate([self.ids, *ids])
        fresh = np.arange(len(self.words), len(self.words) + len(new))
        self.words = pa.concat_arrays([self.words, new])
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = fresh
        return place

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of UTF-8: the ids, the byte where each begins, and the number of ids of each row."""
        if not self.by_word:
            return self._encode_whole(data, off)
        starts = word_starts(data, off, self.special)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
        spans = np.append(starts, len(data)).astype(np.int64)
        split = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(data.tobytes())]).dictionary_encode()
        place = self._known(split.dictionary)[split.indices.to_numpy()]
        each = self.count[place]
        total = np.cumsum(each)
        pick = np.arange(total[-1])
        pick += np.repeat(self.first[place] - (total - each), each)
        ids = self.ids[pick]
        lengths = self.bytes_of[ids]
        at = np.cumsum(lengths) - lengths  # tokens cover the text without gaps
        rows = np.searchsorted(starts, off)
        return ids, at, np.diff(np.append(0, total)[rows])


    def _encode_whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        n = np.array([len(e.ids) for e in found], np.int64)
        ids = np.array([i for e in found for i in e.ids], np.int64)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.array([a for e in found for a, _ in e.offsets], np.int64) + np.repeat(np.searchsorted(chars, off[:-1]), n)
        return ids, chars[first], n


_encoder = cache(Encoder)


# ---- files of equal-length sequences


@dataclass(frozen=True)
class TokenFiles:
    vocabulary: str | None = None
    #: Id after each document, ids of a sequence, and sequences of a record batch.
    end_id: int = 0
    length: int = 2048
    batch: int = 256
    #: Bytes of text of a file, unless that makes more files than so many.
    file_bytes: int = 16 << 20
    most_files: int = 50_000


class _SequenceWriter:
    """Ids in a row into an Arrow file: record batches of fixed-size lists ``ids`` and of ``mask`` (false: filled up at the end)."""

    def __init__(self, stream, kind: np.dtype, cfg: TokenFiles):
        self.cfg, self.kind = cfg, kind
        ids, mask = pa.list_(pa.from_numpy_dtype(kind), cfg.length), pa.list_(pa.bool_(), cfg.length)
        self.schema = pa.schema([pa.field("ids", ids), pa.field("mask", mask)])
        self.out = pa.ipc.new_file(stream, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.n += len(ids)
        whole = self.cfg.length * self.cfg.batch
        if self.n >= whole:
            ids = np.concatenate(self.waiting)
            for i in range(0, self.n - whole + 1, whole):
                self._write(ids[i : i + whole])
            self.waiting = [ids[self.n - self.n % whole :]]
            self.n %= whole

    def _write(self, ids: np.ndarray) -> None:
        full = -len(ids) % self.cfg.length
        mask = np.ones(len(ids) + full, bool)
        mask[len(ids) :] = False
        ids = np.append(ids, np.full(full, self.cfg.end_id, self.kind))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.cfg.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._write(np.concatenate(self.waiting))
        self.out.close()


def write_tokens(batches: Iterator[pa.RecordBatch], folder: str, cfg: TokenFiles) -> Iterator[pa.RecordBatch]:
    """A partition's (doc_id, text), in order, to one file of sequences and one of (doc_id, start, n_tokens): (part, uri, docs, tokens).

    A file takes its name when it is whole, so tasks may run twice.
    """
    encoder = _encoder(cfg.vocabulary)
    kind = np.dtype(np.uint16 if max(encoder.tokenizer.get_vocab_size(), cfg.end_id + 1) <= 1 << 16 else np.uint32)
    task = TaskContext.get()
    uri = f"{folder}/part-{task.partitionId():08d}"
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{task.taskAttemptId()}"
    doc_ids, counts = [], []
    with fs.open_output_stream(own + ".ids") as stream:
        out = _SequenceWriter(stream, kind, cfg)
        for batch in batches:
            for i, j, data, off in words.pieces(batch.column("text"), Encoder.batch_bytes):
                ids, _, n = encoder.encode(data, off)
                out.add(np.insert(ids, np.cumsum(n), cfg.end_id))
                doc_ids.append(batch.column("doc_id").slice(i, j - i))
                counts.append(n + 1)
        out.close()
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    index = pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
    with fs.open_output_stream(own + ".index") as stream, pa.ipc.new_file(stream, index.schema) as table:
        table.write_table(index)
    for kind_of_file in (".ids", ".index"):
        fs.move(own + kind_of_file, path + kind_of_file)
    yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "uri": [uri], "docs": [len(n)], "tokens": [int(n.sum())]})


def read_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (uri, base) to their documents (doc_id, start, n_tokens, ids_crc32), read batch by batch."""
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
            fs, path = file_system(uri)
            with fs.open_input_file(path + ".index") as f:
                index = pa.ipc.open_file(f).read_all().combine_chunks()
            start = index.column("start").to_numpy()
            ends = start + index.column("n_tokens").to_numpy()
            crcs = np.zeros(len(ends), np.int64)
            with fs.open_input_file(path + ".ids") as f:
                reader, lo = pa.ipc.open_file(f), 0
                for k in range(reader.num_record_batches):
                    ids = reader.get_batch(k).column("ids").flatten().to_numpy().astype("<u4")
                    hi = lo + len(ids)
                    for d in range(int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(start, hi))):
                        crcs[d] = zlib.crc32(ids[max(start[d] - lo, 0) : ends[d] - lo].tobytes(), int(crcs[d]))
                    lo = hi
            yield pa.RecordBatch.from_arrays([index.column("doc_id").chunk(0) if len(ends) else pa.array([], pa.int64()), pa.array(start + base), pa.array(ends - start), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, cfg: TokenFiles | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text) in the order of doc_id; (part, uri, docs, tokens, base) of the files.

    base is the number of ids in the files before. A null text is empty, every document has its end id. Null doc_ids come first; rows of one
    doc_id stand in the order of their texts' first 32 characters, then of a hash. Other columns are ignored.
    """
    cfg = cfg or TokenFiles()
    cfg = cfg if cfg.vocabulary else replace(cfg, vocabulary=default_vocabulary())
    spark = docs.sparkSession
    find_package(spark)
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col("doc_id"), F.substring("text", 1, 32), F.xxhash64("text"), F.col("tie")]  # rows without doc_id, and of one, are many ranges' too
    ordered = docs.repartitionByRange(min(cfg.most_files, max(1, -(-size // cfg.file_bytes))), *order).sortWithinPartitions(*order).select("doc_id", "text")
    folder = folder or new_folder(spark, "tokens")
    files = cut(spark, ordered.mapInArrow(words.tidied(write_tokens, folder=folder, cfg=cfg), "part long, uri string, docs long, tokens long"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files; start counts the ids of all documents before."""
    files = files.select("uri", "base")
    return files.repartition(max(1, files.count())).mapInArrow(words.tidied(read_tokens), "doc_id long, start long, n_tokens long, ids_crc32 long")


# ---- counts by section


@dataclass(frozen=True)
class SectionCounts:
    vocabulary: str | None = None


def allocate(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span [a, b) among disjoint ascending sections [sa, sb), and whether it reaches into more than one.

    A token that does goes to the section with most of its bytes, of equals to the first; -1: it is in none.
    """
    first, last = np.searchsorted(sb, a, side="right"), np.searchsorted(sa, b, side="left") - 1
    crosses = first < last
    out = np.where(first <= last, first, -1)
    for t in np.flatnonzero(crosses).tolist():
        s = np.arange(first[t], last[t] + 1)
        out[t] = s[np.argmax(np.minimum(sb[s], b[t]) - np.maximum(sa[s], a[t]))]
    return out, crosses


def _sections(column: pa.Array, chars: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """(row, name, first, end) of the sections that count, in order, clipped to the texts' characters and to where the one before ends."""
    rows = []
    for r, own in enumerate(column.to_pylist()):
        spans = [(x["first"], x["end"], k, x["section"]) for k, x in enumerate(own or []) if x and x["first"] is not None and x["end"] is not None]
        done = 0
        for first, end, _, name in sorted(spans, key=lambda x: x[:3]):
            end = max(done, min(end, int(chars[r])))
            rows.append((r, name, min(max(first, done), end), end))
            done = end
    row, name, lo, hi = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
    return np.array(row, np.int64), name, np.array(lo, np.int64), np.array(hi, np.int64)


def count_sections(batches: Iterator[pa.RecordBatch], cfg: SectionCounts, given: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text[, sections]) to (doc_id, section, first_char, end_char, n_tokens, n_crossing)."""
    encoder = _encoder(cfg.vocabulary)
    for batch in batches:
        for i, j, data, off in words.pieces(batch.column("text"), Encoder.batch_bytes):
            ids, a, per_row = encoder.encode(data, off)
            row_end = np.repeat(off[1:], per_row)
            b = np.minimum(np.append(a[1:], len(data)), row_end) if len(a) else a
            chars = np.flatnonzero((data & 0xC0) != 0x80)
            base = np.searchsorted(chars, off)  # character where each row begins
            if given:
                row, name, lo, hi = _sections(batch.column("sections").slice(i, j - i), np.diff(base))
                to = np.append(chars, len(data))
                sa, sb = to[lo + base[row]], to[hi + base[row]]
            else:  # lines, each with the line end that follows it
                breaks = np.flatnonzero(data == 10) + 1
                begin = off[:-1][np.diff(off) > 0]
                sa = np.unique(np.concatenate((begin, breaks[~np.isin(breaks, off)])))
                sb = np.append(sa[1:], len(data))[: len(sa)]
                row = np.searchsorted(off, sa, side="right") - 1
                name = (np.arange(len(sa)) - np.searchsorted(row, row)).astype(str).tolist()
            full = np.flatnonzero(sa < sb)
            place, crosses = allocate(a, b, sa[full], sb[full])
            place = np.append(full, -1)[place]
            n = np.bincount(place[place >= 0], minlength=len(sa))
            cross = np.bincount(place[crosses], minlength=len(sa))
            outside = np.bincount(np.repeat(np.arange(j - i), per_row)[place < 0], minlength=j - i)
            rest = np.flatnonzero((outside > 0) | ~np.isin(np.arange(j - i), row))  # what is in no section; documents without sections
            ids_of = batch.column("doc_id").slice(i, j - i)
            first, end = np.searchsorted(chars, sa) - base[row], np.searchsorted(chars, sb) - base[row]
            none = [None] * len(rest)
            columns = (pa.array([*name, *none], pa.string()), pa.array([*first.tolist(), *none], pa.int64()), pa.array([*end.tolist(), *none], pa.int64()), pa.array(np.append(n, outside[rest]).astype(np.int64)), pa.array(np.append(cross, np.zeros(len(rest))).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(np.append(row, rest).astype(np.int64))), *columns], ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"])


def section_tokens(docs: DataFrame, cfg: SectionCounts | None = None) -> DataFrame:
    """Tokens of each document by section: (doc_id, section, first_char, end_char, n_tokens, n_crossing).

    Sections are those in the column ``sections`` (array of structs of section string, first and end: characters), else the lines, numbered
    from 0, each with its line end; a column of that name and another type is ignored. Sections are taken in the order of their first characters; of
    two that overlap, the later one begins where the earlier ends; bounds beyond the text are clipped, null sections and those with
    null bounds don't count, and sections without characters have no tokens. Documents are encoded whole, once; a token's span is joined to the sections that it meets, and one that crosses a boundary counts (also in n_crossing) for the section with most of its bytes, of equals the first. Tokens in no
    section, and documents without sections or text, have a row with a null section; so a document's rows sum to its tokens. Repeated rows
    are counted each; other columns are ignored.
    """
    cfg = cfg if cfg and cfg.vocabulary else SectionCounts(default_vocabulary())
    find_package(docs.sparkSession)
    kind = docs.schema["sections"].dataType if "sections" in docs.columns else None
    given = isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"section", "first", "end"} <= set(kind.elementType.names)
    to_long = lambda s: F.struct(s["section"].cast("string").alias("section"), s["first"].cast("long").alias("first"), s["end"].cast("long").alias("end"))
    sections = [F.transform("sections", lambda s: F.when(s.isNotNull(), to_long(s))).alias("sections")] if given else []
    rows = docs.select("doc_id", "text", *sections)
    return rows.mapInArrow(words.tidied(count_sections, cfg=cfg, given=given), "doc_id long, section string, first_char long, end_char long, n_tokens long, n_crossing long")
