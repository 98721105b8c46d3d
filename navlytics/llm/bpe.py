"""Byte-level BPE encoding and decoding in Arrow batches, with the tokenizers library.

Both pre-tokenizers used here cut a text before every single space that stands between two characters that are not white
space, whatever lies around it. So a text falls into chunks that are encoded alone. A batch's distinct chunks are found
and looked up among the remembered ones by Arrow, and the ids of all its texts are gathered at once. With a rank file, a chunk met
for the first time is split into pieces by the public pattern and the library's model merges each piece; pieces are remembered, too.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

GPT_JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The end-of-document id of the packed and stored sequences.
END_ID = 2
#: Chunks whose ids a worker remembers; beyond that, the half met last stays.
REMEMBERED = 500_000
#: The same where pieces are remembered, too: chunks met again cost little there, and two workers share an executor's memory with its heap.
REMEMBERED_BY_PIECES = 150_000
#: Pieces of chunks whose ids a worker remembers before it starts anew.
PIECES = 75_000
ID = np.dtype("<u4")

_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = "".join(c for c in map(chr, range(1 << 16)) if c.isspace())
#: A text that may not be cut at every space, for Arrow: some space has white space or an end of the text beside it.
_ODD = rf"\A | \z|[{_WHITE}] | [{_WHITE}]"
#: What may be encoded in one string with others: no white space but a space before it and single newlines within it.
_LINES = re.compile(r" ?\S+(?:\n\S+)*")
#: The public pattern with Python's classes of letters, digits and white space.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
#: Words of Latin letters with marks behind them, over one line or several: every class of characters is one piece, with the space before the first.
_PLAIN = r"[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]*(?:\n[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]*)*"
_MARKS = re.compile(r"[.,;:!?]+").sub


def joined(tokens: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes behind ids."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, ID).tolist()))


def byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks:
    """Chunks and their ids in flat arrays, with the turn in which each was met last."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, ID)
        self.starts, self.counts, self.met = (np.empty(0, np.int64) for _ in range(3))

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array, turn: int) -> np.ndarray:
        """The place of each word, -1 where there is none."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[at[at >= 0]] = turn
        return at

    def add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray, turn: int) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.words, self.ids = pa.concat_arrays([self.words, words]), np.concatenate([self.ids, ids])
        self.counts, self.met = np.concatenate([self.counts, counts]), np.concatenate([self.met, np.full(len(words), turn)])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words at some places, one behind the other."""
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def keep_last(self, n: int) -> None:
        """Forget all but the ``n`` words met last."""
        at = np.sort(np.argsort(-self.met, kind="stable")[:n])
        words, met = self.words.take(pa.array(at)), self.met[at]
        ids, counts = self.gather(at)
        self.words, self.met, self.ids, self.counts, self.starts = words, met, ids, counts, np.cumsum(counts) - counts


class Codec:
    """Ids of texts and back. ``encode_one`` gives the ids of a string, ``tokens`` the bytes of each id.

    Where pieces can be encoded alone, ``merge`` gives the ids of many and ``same`` says whether a character is classed as by ``encode_one``.
    ``plain`` encodes a text of chunks like ``_PLAIN``, each with a space before it, as ``encode_one`` does.
    """

    def __init__(self, encode_one: Callable[[str], list[int]], tokens: dict[int, bytes],
                 merge: Callable[[list[str]], list[bytes]] | None = None, same: Callable[[str], bool] | None = None,
                 plain: Callable[[str], list[int]] | None = None):
        self._one, self._tokens, self._merge, self._same, self._plain_text = encode_one, tokens, merge, same, plain
        self._most = REMEMBERED if merge is None else REMEMBERED_BY_PIECES
        self._pieces: dict[str, bytes] = {}
        self._plain: set[str] = set()  # characters found to be the same, and others
        self._strange: set[str] = set()
        self._line = ID.type(encode_one("\n")[0])
        self._size = np.zeros(max(tokens) + 1, np.int64)  # bytes of each id
        self._size[[*tokens]] = [len(b) for b in tokens.values()]
        self._first: dict[str, bytes] = {}
        self._spaced = Chunks()  # by the chunk without the space before it
        self._turn = 0

    def _cuttable(self, word: str) -> bool:
        """Whether every character of a chunk is classed as in the pattern; new ones are tried."""
        if self._plain.issuperset(word):
            return True
        for c in set(word) - self._plain - self._strange:
            (self._plain if self._same(c) else self._strange).add(c)
        return self._plain.issuperset(word)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many chunks, by pieces where that can be done."""
        if self._merge is None:
            return self._learn_whole(words)
        if len(self._pieces) > PIECES:
            self._pieces = {}
        cut = {w: _PIECE(w) for w in words if self._cuttable(w)}
        new = [*set(chain.from_iterable(cut.values())).difference(self._pieces)]
        for k in range(0, len(new), 1024):
            self._pieces.update(zip(new[k:k + 1024], self._merge(new[k:k + 1024])))
        get = self._pieces.__getitem__
        out = {w: b"".join(map(get, p)) for w, p in cut.items()}
        return out if len(cut) == len(words) else out | self._learn_whole([w for w in words if w not in cut])

    def _learn_whole(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many chunks by one call: a newline between two characters that are not white space is always an id of its own."""
        joined = [w for w in words if _LINES.fullmatch(w)]
        out = {w: np.array(self._one(w), ID).tobytes() for w in words if not _LINES.fullmatch(w)} if len(joined) < len(words) else {}
        for k in range(0, len(joined), 4096):
            part = joined[k:k + 4096]
            ids = np.array(self._one("\n".join(part)), ID)
            raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self._line)).tolist(), 4 * len(ids)]
            at, n = 0, -1
            for w in part:
                n += 1 + w.count("\n")
                out[w] = raw[at:ends[n]]
                at = ends[n] + 4
        return out

    def _learn_spaced(self, words: pa.Array) -> np.ndarray:
        """Remember the ids of new chunks with the space before them; their places."""
        if self._merge is not None:
            parts = [(np.arange(len(words)), lambda some: self._learn_each(some, self._learn))]
        else:
            plain = pc.match_substring_regex(words, rf"\A(?:{_PLAIN})\z").to_numpy(zero_copy_only=False) & (self._plain_text is not None)
            rest = np.flatnonzero(~plain)
            tail = np.array([w[-1].isspace() for w in words.take(pa.array(rest)).to_pylist()], bool)  # a text's last chunk may end in white space
            parts = [(np.flatnonzero(plain), lambda some: self._learn_joined(some, self._plain_text)),
                     (rest[~tail], lambda some: self._learn_joined(some, self._one)), (rest[tail], lambda some: self._learn_each(some, self._learn_whole))]
        at, n = np.empty(len(words), np.int64), len(self._spaced)
        learnt = [(k[i:i + 4096], learn) for k, learn in parts for i in range(0, len(k), 4096)]
        got = [learn(words.take(pa.array(k))) for k, learn in learnt]
        order = np.concatenate([k for k, _ in learnt])
        at[order] = n + np.arange(len(words))
        self._spaced.add(words.take(pa.array(order)), *map(np.concatenate, zip(*got)), self._turn)
        return at

    def _learn_each(self, words: pa.Array, learn: Callable[[list[str]], dict[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        spaced = [" " + w for w in words.to_pylist()]
        known = learn(spaced)
        ids = [known[w] for w in spaced]
        return np.frombuffer(b"".join(ids), ID), np.array([len(x) // 4 for x in ids], np.int64)

    def _learn_joined(self, words: pa.Array, encode: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of chunks as one text, which is cut again where the bytes of its ids add up to a chunk's end."""
        ids = np.array(encode(" " + " ".join(words.to_pylist())), ID)
        at = np.cumsum(self._size[ids])
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(at, ends)
        if last[-1] != len(ids) - 1 or (at[last] != ends).any():  # some bytes have no id of their own
            return self._learn_each(words, self._learn_whole)
        return ids, np.diff(last, prepend=-1)

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        self._turn += 1
        if len(self._first) > self._most // 2:
            self._first = {}
        if len(self._spaced) > self._most:
            self._spaced.keep_last(self._most // 2)
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False) & some
        even, odd = np.flatnonzero(some & ~odd), np.flatnonzero(odd)
        cut = pc.split_pattern(texts.take(pa.array(even)), " ")
        chunks, sizes = cut.flatten(), pc.list_value_length(cut).to_numpy().astype(np.int64)
        if len(odd):
            parts = [_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
            chunks = pa.concat_arrays([chunks, pa.array(chain.from_iterable(parts), chunks.type)])
            sizes = np.concatenate([sizes, [len(p) for p in parts]])
        starts = np.cumsum(sizes) - sizes
        first = chunks.take(pa.array(starts)).to_pylist()
        new = [*set(first).difference(self._first)]
        self._first.update(self._learn(new) if new else {})

        rest = np.ones(len(chunks), bool)
        rest[starts] = False
        met = chunks.filter(pa.array(rest)).dictionary_encode()
        at = self._spaced.find(met.dictionary.cast(pa.string()), self._turn)
        if len(unmet := np.flatnonzero(at < 0)):
            at[unmet] = self._learn_spaced(met.dictionary.cast(pa.string()).take(pa.array(unmet)))
        ids, counts = self._spaced.gather(at[met.indices.to_numpy()])
        ends = 4 * np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes - 1)]
        raw, out = ids.tobytes(), [b""] * len(texts)
        for k, f, a, b in zip(np.concatenate([even, odd]).tolist(), first, [0, *ends.tolist()], ends.tolist()):
            out[k] = self._first[f] + raw[a:b]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind the ids. Characters split over several ids come together again here."""
        return joined(self._tokens, ids)

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character (code point) of each id; ids within one character share it."""
        parts = [self._tokens[i] for i in np.frombuffer(ids, ID).tolist()]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        return (char[ends - [len(p) for p in parts]], char[ends - 1] + 1) if parts else (ends, ends)


def _as_split(pre, c: str) -> bool:
    """Whether a pre-tokenizer of the library cuts around a character as the pattern does, beside letters, digits and marks. Not for the zero byte."""
    probe = f"a{c}a1{c}1-{c}-"
    return c != "\0" and [probe[a:b] for _, (a, b) in pre.pre_tokenize_str(probe)] == _PIECE(probe)


def _merging(model) -> Callable[[list[str]], list[bytes]]:
    """Ids of pieces by a model of the library, which reads bytes as characters of the alphabet. The zero byte stands between pieces."""
    from tokenizers import Tokenizer

    t, chars = Tokenizer(model), byte_alphabet()
    zero, zero_id = chars[0], ID.type(model.token_to_id(chars[0]))

    def ids(pieces: list[str]) -> list[bytes]:
        parts = [zero] * (2 * len(pieces))
        parts[::2] = [p.encode().decode("latin-1").translate(chars) for p in pieces]
        found = np.array(t.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, ID)
        raw, ends = found.tobytes(), (4 * np.flatnonzero(found == zero_id)).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]

    return ids


def _plain_text(model) -> Callable[[str], list[int]]:
    """Ids of a text of plain chunks by a model of the library: its pieces are written in the alphabet with a space between them."""
    from tokenizers import Tokenizer, pre_tokenizers

    t, chars = Tokenizer(model), byte_alphabet()
    t.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    high = [(chr(b), c) for b, c in chars.items() if b > 127 and c != chr(b)]

    def ids(text: str) -> list[int]:
        if not text.isascii():
            text = text.encode().decode("latin-1")
            for b, c in high:
                text = text.replace(b, c)
        text = _MARKS(r" \g<0>", text.replace(" ", " " + chars[32]).replace("\n", f" {chars[10]} "))
        return t.encode_batch_fast([text[1:]], add_special_tokens=False)[0].ids

    return ids


@functools.cache
def from_json(path: str) -> Codec:
    """A byte-level tokenizer file as the tokenizers library reads it, without special tokens being added."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    bytes_of = {c: b for b, c in byte_alphabet().items()}
    tokens = {}
    for word, i in t.get_vocab(with_added_tokens=True).items():
        tokens[i] = bytes(bytes_of[c] for c in word) if all(c in bytes_of for c in word) else word.encode()
    for i, added in t.get_added_tokens_decoder().items():
        tokens[i] = added.content.encode()
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre = said["pre_tokenizer"] or {}
    # the words of plain chunks are cut here as this pre-tokenizer cuts them; other files are left to the library
    gpt = said["normalizer"] is None and said["post_processor"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    clear = all("<" in a.content for a in t.get_added_tokens_decoder().values())  # so no plain chunk holds one
    return Codec(lambda text: t.encode_batch_fast([text], add_special_tokens=False)[0].ids, tokens, plain=_plain_text(t.model) if gpt and clear else None)


@functools.cache
def ranked(path: str) -> dict[int, bytes]:
    """The bytes of each id of a file of byte ranks."""
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


@functools.cache
def from_ranks(path: str) -> Codec:
    """A file of byte ranks, run by the tokenizers library.

    The library wants merges, so every token is listed with each way to split it into two tokens, by rank. Only a token of three
    bytes or more has several such ways, and which one goes first matters only where it can be made twice in a piece. Pieces in
    which three bytes repeat, and chunks with characters that the libraries class differently, are therefore encoded by the
    rank file's own rule; all others keep the ids of the tokenizers library.
    """
    import tiktoken
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, models, pre_tokenizers

    tokens = ranked(path)
    ranks = {t: i for i, t in tokens.items()}
    chars = byte_alphabet()
    word = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(word[t[:i]], word[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    merged = _merging(models.BPE({word[k]: v for k, v in ranks.items()}, merges, cache_capacity=0, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    rule = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = {bytes([b]): b for b in range(256)}
    # a class of characters as tiktoken sees it: what the pattern leaves out has no ids
    classes = [(tiktoken.Encoding("class", pat_str=theirs, mergeable_ranks=single, special_tokens={}), re.compile(ours))
               for theirs, ours in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))]

    def same(c: str) -> bool:
        return all(bool(theirs.encode_ordinary(c)) == bool(ours.match(c)) for theirs, ours in classes) and _as_split(split, c)

    def repeats(piece: str) -> bool:
        raw = piece.encode()
        return len({raw[i:i + 3] for i in range(len(raw) - 2)}) < len(raw) - 2

    def merge(pieces: list[str]) -> list[bytes]:
        return [np.array(rule.encode_ordinary(p), ID).tobytes() if repeats(p) else ids for p, ids in zip(pieces, merged(pieces))]

    return Codec(rule.encode_ordinary, tokens, merge, same)


def codec(path: str) -> Codec:
    return from_ranks(path) if path.endswith(".tiktoken") else from_json(path)


def decoder(path: str) -> Callable[[bytes], bytes]:
    """Bytes of ids. A rank file needs no encoder for that, which would take a worker's memory beside that of the encoding one."""
    return functools.partial(joined, ranked(path)) if path.endswith(".tiktoken") else from_json(path).decode


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about ``most`` bytes of text each, one row at least, so that a part's ids stay small."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str = MULTI_RANKS, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids binary) for every row; with ``offsets`` also the first and past-the-last character of each id.

    One row per input row, nulls in the id and repeated rows included. A null text has no ids. Texts of any length are taken whole.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids binary" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for b in slices(whole, 1):
                ids = c.encode(b.column(1))
                cols, names = [b.column(0), pa.array(ids, pa.binary())], [id_col, "ids"]
                if offsets:
                    both = [c.offsets(x) for x in ids]
                    cols += [pa.array([s.tolist() for s, _ in both], pa.list_(pa.int32())), pa.array([e.tolist() for _, e in both], pa.list_(pa.int32()))]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MULTI_RANKS, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with the bytes of their ids as a further column ``decoded`` (one of that name is replaced). Null ids decode to null."""
    others = [c for c in encoded.columns if c != "decoded"]
    src = encoded.select(*[F.col(f"`{c}`") for c in others])
    at = others.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back_of = decoder(path)
        for b in batches:
            back = [None if x is None else back_of(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary())], [*others, "decoded"])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, path: str = MULTI_RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of each text and of what they decode to."""
    both = decode(encode(docs, path, id_col, text_col), path)
    return both.select(
        F.col(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
