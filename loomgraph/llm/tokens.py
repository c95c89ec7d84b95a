"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds, for each range of the order, `NAME.bin` (the ids of its documents,
back to back, little-endian, 16 bits wide if the vocabulary allows it and else 32)
and `NAME.idx`:

    8 bytes   LOOMTOK2
    4 x u64   bytes per id, documents, ids, documents whose doc_id is null
    u64 ...   offset of each document in ids, and the end (documents + 1)
    i64 ...   doc_id of each document in the order of the file, 0 for null
    u64 ...   numbers of the documents whose doc_id is null

`manifest.json` lists the parts with the number of ids before each (prefix sums),
so a document's place in the whole is the base of its part plus its offset. Each
attempt at a part has a NAME of its own, and the manifest names one attempt's files
for each part; what other attempts have left is removed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"LOOMTOK2"
#: Words whose ids a worker remembers: twice this many at most, some 80 MB.
REMEMBERED = 200_000
#: Characters of the texts that are encoded together, one text at least.
TOGETHER = 4 << 20
#: Words that the library gets at once.
AT_ONCE = 64
#: White space that doesn't stand alone, and such a run with the words it touches.
_TWO, _RUN = re.compile(r"\s\s"), re.compile(r" ?\S*+\s{2,}\S*(?:\s{2,}\S*)*")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Ids(dict):
    """Ids of " " + word, as bytes, for words that follow a single space.

    The byte-level pattern never joins a word with a space before it to what
    stands before that space, nor letters to the punctuation after them, so these
    pieces can be encoded alone. Rarely used words are forgotten: bounded memory."""

    def __init__(self, encode, letters) -> None:
        super().__init__()
        self.encode, self.letters, self.old = encode, letters, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(_PUNCTUATION)
            if not stem.isalpha():
                ids = self.encode(f" {word}")
            elif len(stem) < len(word):
                ids = self[stem] + self.tail(word[len(stem) :])
            else:
                ids = self.letters(word)
        return self.keep(word, ids)

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids

    def tail(self, signs: str) -> bytes:
        """Of the punctuation after a word; kept beside the words."""
        key = f"\t{signs}"
        ids = self.get(key)
        return self.keep(key, self.encode(signs)) if ids is None else ids


class Encoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them. Strings of
    special tokens in a text become their ids, as by the library's default; with
    special_as_text they are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")
        known = json.loads(self.tokenizer.to_str())
        # Texts that hold one of these are encoded whole.
        self.added = [t["content"] for t in known.get("added_tokens") or [] if not (special_as_text and t["special"])]
        kind = known.get("pre_tokenizer") or {}
        # Only for this kind of tokenizer is it known that words can be cut out.
        self.by_word = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not known.get("normalizer") and not known.get("post_processor")
        self.piece, self.together = None, False
        if self.by_word and known["model"]["type"] == "BPE":
            # The model alone, without the machinery around it: half the time.
            self.piece = self.tokenizer.model
            shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.shown = {b: shown.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
            # Bytes from 128 on: those that are letters or signs stand for
            # themselves, the others follow in order.
            alphabet = set(pre_tokenizers.ByteLevel.alphabet())
            loose = [b for b in range(128, 256) if chr(b) not in alphabet]
            rest = [c for c in sorted(alphabet - set(self.shown.values())) if ord(c) > 255]
            self.shown |= {b: chr(b) for b in range(128, 256) if b not in loose}
            self.shown |= dict(zip(loose, rest, strict=True))
            self._prepare()
        self.ids = _Ids(self.direct, self.word)

    def _prepare(self) -> None:
        """For words that the library gets together, as " one two three"."""
        from tokenizers import Tokenizer

        self.bare = Tokenizer(self.piece)
        self.units = np.array([ord(self.shown[b]) for b in range(256)], "<u2")
        space, vocabulary = self.shown[32], self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == space]] = True
        of = {c: b for b, c in self.shown.items()}

        def joins(token: str) -> bool:
            """Whether a token may reach from one word of letters into the next."""
            raw = bytes(of[c] for c in token if c in of)
            try:
                return all(w == "" or w.isalpha() for w in raw.decode().split(" "))
            except UnicodeDecodeError:
                return True

        self.together = not any(map(joins, (t for t in vocabulary if space in t[1:]))) and not any(" " in t for t in self.added)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def word(self, word: str) -> bytes:
        """Of a space and letters: one piece of the pattern."""
        if self.piece is None:
            return self.direct(f" {word}")
        shown = f" {word}".encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.piece.tokenize(shown)]).tobytes()

    def joined(self, words: list[str], letters: bool) -> pa.Array:
        """Ids of a space and each of these words, which hold no white space; letters
        says that they are of letters alone. The token that opens with the space is
        the first one of its word."""
        groups = [" " + " ".join(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)]
        if letters:
            groups = [self.units[np.frombuffer(g.encode(), np.uint8)].tobytes().decode("utf-16-le") for g in groups]
        library, ids = self.bare if letters else self.tokenizer, array(self.code)
        for k in range(0, len(groups), AT_ONCE):
            for found in library.encode_batch_fast(groups[k : k + AT_ONCE], add_special_tokens=False):
                ids.extend(found.ids)
        ids = np.frombuffer(ids, f"<u{self.width}") if words else np.empty(0, f"<u{self.width}")
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words):
            return self.apart([f" {w}" for w in words])
        return pa.LargeListArray.from_arrays(np.append(at, len(ids)), pa.array(ids))

    def apart(self, words: list[str]) -> pa.Array:
        """Ids of each of these texts."""
        found = [e.ids for k in range(0, len(words), AT_ONCE) for e in self.tokenizer.encode_batch_fast(words[k : k + AT_ONCE], add_special_tokens=False)]
        return pa.array(found, pa.large_list(pa.from_numpy_dtype(f"<u{self.width}")))

    def known(self, words: pa.Array) -> pa.Array:
        """Ids of different words, each with the space before it if there is one.
        Stems of letters are encoded without the punctuation behind them, once for
        all words that share them."""
        cut = pc.ascii_rtrim(words, _PUNCTUATION).dictionary_encode()
        spaced = pc.starts_with(cut.dictionary, " ").to_numpy(zero_copy_only=False)
        bare = pc.if_else(spaced, pc.utf8_slice_codeunits(cut.dictionary, 1), cut.dictionary).to_numpy(zero_copy_only=False)
        alpha = np.fromiter(map(str.isalpha, bare), bool, len(bare))
        # Of stems: their places among what is encoded; other words are taken whole.
        stem, place = cut.indices.to_numpy(), np.full(len(bare), -1)
        inner, first = np.flatnonzero(spaced & alpha), np.flatnonzero(~spaced & alpha)
        place[inner], place[first] = np.arange(len(inner)), len(inner) + np.arange(len(first))
        place, n = place[stem], len(inner) + len(first)
        whole = np.flatnonzero(place < 0)
        others = words.take(pa.array(whole)).to_pylist()
        far = np.array([len(w) > 1 and w[0] == " " for w in others], bool)
        place[whole[far]] = n + np.arange(far.sum())
        place[whole[~far]] = n + far.sum() + np.arange((~far).sum())
        n += len(whole)
        # Punctuation behind stems.
        longer = pc.binary_length(words).to_numpy() - pc.binary_length(cut.dictionary).to_numpy()[stem]
        longer[whole] = 0
        tailed = np.flatnonzero(longer)
        signs = [w[-k:] for w, k in zip(words.take(pa.array(tailed)).to_numpy(zero_copy_only=False), longer[tailed].tolist(), strict=True)]
        tails = {t: k for k, t in enumerate(dict.fromkeys(["", *signs]), n)}
        # Stem, punctuation, stem, punctuation ..: every second end is that of a word.
        both = np.full(2 * len(words), n)
        both[::2] = place
        both[2 * tailed + 1] = [tails[t] for t in signs]
        found = pa.concat_arrays([
            self.joined(bare[inner].tolist(), True),
            self.apart(bare[first].tolist()),
            self.joined([w[1:] for w, f in zip(others, far, strict=True) if f], False),
            self.apart([w for w, f in zip(others, far, strict=True) if not f]),
            self.apart(list(tails)),
        ]).take(pa.array(both))
        return pa.LargeListArray.from_arrays(found.offsets[::2], found.values)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each of these texts. Words are told apart in all texts at once,
        and the library gets each different one once."""
        if not self.together:
            return [self.encode(t) for t in texts]
        plain = [_plain(t) and not any(a in t for a in self.added) for t in texts]
        # Plain texts hold no control signs but newlines.
        cut = pc.replace_substring(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), " ", "\0 ")
        cut = pc.split_pattern(pc.replace_substring(cut, "\n", "\0\n\0"), "\0")
        words, stops = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        del cut
        placed = self.known(words.dictionary).take(words.indices)
        ends, ids = placed.offsets.to_numpy()[stops], placed.values.to_numpy()
        done = (ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [next(done) if p else self.encode(t) for t, p in zip(texts, plain, strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as if it were encoded at once."""
        if not self.by_word or any(t in text for t in self.added):
            return self.direct(text)
        if _plain(text) or not _TWO.search(text):
            return self.simple(text)
        out, at = [], 0
        for run in _RUN.finditer(text):
            out += [self.simple(text[at : run.start()]), self.direct(run[0])]
            at = run.end()
        return b"".join([*out, self.simple(text[at:])])

    def simple(self, text: str) -> bytes:
        """Of a text in which each white space stands alone."""
        out, newline = [], b""
        for line in text.split("\n"):
            out.append(newline)
            newline = self.start("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(self.start(first))
            out.extend(map(self.ids.__getitem__, rest))
        return b"".join(out)

    def start(self, word: str) -> bytes:
        """Of a word that has no space before it; kept beside the others."""
        key = f"\n{word}"
        ids = self.ids.get(key)
        return self.ids.keep(key, self.direct(word)) if ids is None else ids


def _plain(text: str) -> bool:
    """Whether it is quickly seen that each white space stands alone: spaces and
    newlines are the only ones, and no two of them touch."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text) and text.replace("\n", " ").isprintable()


def encoder(path: str, special_as_text: bool) -> Encoder:
    """One per worker process; it outlives the task."""
    state = sys.modules.setdefault("_loomgraph_worker", types.ModuleType("_loomgraph_worker"))
    found = getattr(state, "encoder", None)
    if found is None or found[0] != (path, special_as_text):
        state.encoder = None  # the old one goes before the new one comes
        state.encoder = found = ((path, special_as_text), Encoder(path, special_as_text))
    return found[1]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _together(texts: pd.Series) -> Iterator[list[str]]:
    """Texts to be encoded together, in their order; null ones are empty."""
    some, size = [], 0
    for text in texts:
        text = text or ""
        if some and size + len(text) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _write(path: str, tokenizer: str, end_id: int, special_as_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, enc, store = TaskContext.get().partitionId(), None, None
        ids: list[np.ndarray] = []
        offsets, nulls, docs = [np.zeros(1, np.uint64)], [], 0
        for frame in frames:
            if not len(frame):
                continue
            if enc is None:
                enc = encoder(tokenizer, special_as_text)
                end = np.array([end_id], f"<u{enc.width}").tobytes()
                store, root = filesystem(path)
                name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}"
                out = store.open_output_stream(f"{root}/{name}.bin")
            sizes = []
            for texts in _together(frame["text"]):
                for raw in enc.encode_all(texts):
                    out.write(raw + end)
                    sizes.append(len(raw) // enc.width + 1)
            nulls.append(docs + np.flatnonzero(frame["doc_id"].isna()))
            docs += len(frame)
            ids.append(frame["doc_id"].fillna(0).astype("int64").to_numpy())
            offsets.append(offsets[-1][-1] + np.cumsum(sizes).astype(np.uint64))
        if enc is None:
            return
        out.close()
        total, missing = int(offsets[-1][-1]), np.concatenate(nulls)
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(MAGIC + np.array([enc.width, docs, total, len(missing)], "<u8").tobytes())
            index.write(np.concatenate(offsets).astype("<u8").tobytes() + np.concatenate(ids).astype("<i8").tobytes() + missing.astype("<u8").tobytes())
        yield pd.DataFrame({"part": [part], "name": [name], "n_docs": [docs], "n_tokens": [total]})

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, order: tuple = ("doc_id",), special_as_text: bool = False) -> list[dict]:
    """Encode all texts into the folder `path`, which must be one that all executors
    share, and return its manifest. The order is by these columns of docs, ascending
    and nulls first."""
    spark = docs.sparkSession
    store, root = filesystem(path)
    store.create_dir(root, recursive=True)
    keys = [F.col(c).alias(f"_by_{k}") for k, c in enumerate(order)]
    by = [f"_by_{k}" for k in range(len(keys))]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keys)
    ranged = (ranged.repartitionByRange(parts, *by) if parts else ranged.repartitionByRange(*by)).sortWithinPartitions(*by).select("doc_id", "text")
    # One row per partition comes back.
    done = sorted((r.asDict() for r in ranged.mapInPandas(_write(path, tokenizer, end_id, special_as_text), "part int, name string, n_docs long, n_tokens long").collect()), key=lambda r: r["part"])
    base = 0
    for r in done:
        r["base"] = base
        base += r["n_tokens"]
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"tokens": base, "parts": done}).encode())
    named = {f"{r['name']}.{kind}" for r in done for kind in ("bin", "idx")} | {"manifest.json"}
    for info in store.get_file_info(pafs.FileSelector(root)):
        if info.base_name not in named and info.is_file:
            store.delete_file(info.path)
    return done


class Part:
    """A part's offsets, doc_ids and nulls, and its ids, which are memory-mapped, or
    read piece by piece where the store isn't a mounted one."""

    def __init__(self, path: str, name: str) -> None:
        store, root = filesystem(path)
        with store.open_input_stream(f"{root}/{name}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.idx is not an index of token ids")
        width, docs, self.total, nulls = map(int, np.frombuffer(raw, "<u8", 4, 8))
        self.kind = np.dtype(f"<u{width}")
        self.offsets = np.frombuffer(raw, "<u8", docs + 1, 40).astype(np.int64)
        self.ids = np.frombuffer(raw, "<i8", docs, 40 + 8 * (docs + 1))
        self.nulls = np.frombuffer(raw, "<u8", nulls, 40 + 8 * (2 * docs + 1)).astype(np.int64)
        self.data = self.file = None
        if isinstance(store, pafs.LocalFileSystem):
            self.data = np.memmap(f"{root}/{name}.bin", self.kind, "r", shape=(self.total,))
        else:
            self.file = store.open_input_file(f"{root}/{name}.bin")

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place of the part to another."""
        if self.data is not None:
            return self.data[start:stop]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * size, start * size), self.kind)


def _read(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, base in zip(frame["name"], frame["base"], strict=True):
                part = Part(path, name)
                for a in range(0, len(part.ids), 10_000):
                    b = min(a + 10_000, len(part.ids))
                    at = part.offsets[a : b + 1]
                    crc = [zlib.crc32(part.tokens(x, y).astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                    doc_id = pd.array(part.ids[a:b], "Int64")
                    doc_id[part.nulls[(part.nulls >= a) & (part.nulls < b)] - a] = pd.NA
                    yield pd.DataFrame({"doc_id": doc_id, "start": base + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crc})

    return run


def read_tokens(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    # As a literal: rows of the driver's Python would start further workers, which stay.
    known = json.dumps([{"name": r["name"], "base": r["base"]} for r in manifest])
    parts = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(known), "array<struct<name string, base long>>")))
    return parts.repartition(max(1, len(manifest))).mapInPandas(_read(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, order: tuple = ("doc_id",), special_as_text: bool = False) -> DataFrame:
    """Write the files and describe every document as read back from them.

    Null and empty texts hold the end id alone. In the order by doc_id a null one
    comes first, and rows with the same doc_id stand side by side in any order. An
    empty table writes an empty manifest and gives no rows; other columns are
    ignored."""
    return read_tokens(docs.sparkSession, path, write_tokens(docs, path, tokenizer, end_id, parts, order, special_as_text))
