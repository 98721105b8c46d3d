"""Tokens, packing and token files against the libraries' own plain calls."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from navlytics.llm import bpe, packing, token_files

PLAIN = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
RULE = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))})
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\tx y\n\n z ", "it's they'll 're", "x" * 40, "a" * 1001 + " " + "ab" * 333,
    "naïve café 東京 🙂🙃 été", "1 22 333 4444", "a b  c", "don't  stop", "end\n", "<|endoftext|> in text <|endoftext|>", "!!! ??? ...", " \u0085 q",
    "-" * 99 + "=" * 77, "word " * 900, "ááá " * 50, "\x1c a \x1c b", "a\r\nb c", "é x",
]
SCHEMA = "doc_id long, text string, ids string, lang string"


def docs(spark, n=1):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS * n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoding_equals_the_libraries(spark):
    a = {r.doc_id: r.ids for r in bpe.encode(docs(spark), bpe.GPT_JSON).collect()}
    b = {r.doc_id: r.ids for r in bpe.encode(docs(spark), bpe.MULTI_RANKS).collect()}
    for i, t in enumerate(TEXTS):
        assert bytes(a[i]) == u32(PLAIN.encode(t or "", add_special_tokens=False).ids), t
        assert bytes(b[i]) == u32(RULE.encode_ordinary(t or "")), t


def test_round_trip(spark):
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = RULE.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(u32(ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark).limit(0)).count() == 0


def test_pieces_and_repeats_of_random_texts():
    """Pieces, characters that libraries class differently, repeats and added tokens against the libraries' plain calls."""
    rng = random.Random(5)
    parts = ["a", "b", "é", "я", "東", "\u0558", "\u208f", "\u0301", "1", "\u0663", "²", "_", "'", "'s", "'ll", "'S", "-", "!", " ", " ", "  ", "\n", "\n\n",
             "\t", "\r\n", "\u0085", "\u00a0", "\u2003", "\x1c", "\0", "🙂", "<|endoftext|>", "the", "aaa", "ababab", "😀😀", "ſ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(20_000)]
    for path, plain in ((bpe.GPT_JSON, lambda t: PLAIN.encode(t, add_special_tokens=False).ids), (bpe.MULTI_RANKS, RULE.encode_ordinary)):
        c = bpe.codec(path)
        for k in range(0, len(texts), 700):
            for t, got in zip(texts[k:k + 700], c.encode(texts[k:k + 700])):
                assert got == u32(plain(t)), t


def test_offsets_cover_the_text(spark):
    for r in bpe.encode(docs(spark), bpe.MULTI_RANKS, offsets=True).collect():
        t = TEXTS[r.doc_id] or ""
        n = len(r.ids) // 4
        assert len(r.starts) == len(r.ends) == n
        if n:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)
            assert all(a < b for a, b in zip(r.starts, r.ends)) and all(r.starts[k + 1] in (r.ends[k], r.ends[k] - 1) for k in range(n - 1))


def test_token_files(spark):
    frame = docs(spark, 3).union(spark.createDataFrame([(None, "no id", "c", None), (4, TEXTS[4], "c", None)], SCHEMA))
    got = sorted(token_files.scan(token_files.write(frame)).collect(), key=lambda r: r.start)
    assert len(got) == frame.count()
    want = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (d, t) in zip(got, want):
        ids = [*PLAIN.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)
    assert token_files.scan(token_files.write(frame.limit(0))).count() == 0


def test_blocks_shorter_than_a_document(spark, monkeypatch):
    ids = np.arange(70_000, dtype="<u4")[::-1] * 977 % 66_000
    table, control, data = token_files.encode_ids(ids.astype("<u4"))
    assert (token_files.decode_ids(len(ids), table, control, data) == ids).all()
    wide = np.array([0, 2**32 - 1, 2**24, 5], "<u4")
    assert (token_files.decode_ids(4, *token_files.encode_ids(wide)) == wide).all()


def test_packing(spark):
    rows = packing.pack(docs(spark, 4)).collect()
    per = {}
    bins = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, t in enumerate(TEXTS * 4):
        ids = u32([*PLAIN.encode(t or "", add_special_tokens=False).ids, 2])
        parts = sorted(per[d], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in parts) == ids and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 1024 for r in parts[1:]) and [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert len(parts) == -(-len(ids) // 4096)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_bins_close_the_fullest():
    b = packing.Bins(10, 2)
    assert b.place(4) == (0, None) and b.place(7) == (1, None)
    assert b.place(3) == (1, None) and b.place(6) == (0, None)  # both full
    assert b.place(9)[1] in (0, 1)
    c = packing.Bins(10, 2)
    c.place(5), c.place(8)
    assert c.place(6) == (2, 1)


@pytest.mark.parametrize("n,want", [(0, []), (1, [(0, 1)]), (1024, [(0, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, want):
    assert packing.cut(n) == want


def test_codec_of_a_rank_file_remembers_less():
    """Two workers beside a heap went over an executor's 3000 MB; what is forgotten is encoded again."""
    import tiktoken  # noqa: F401
    from navlytics.llm import bpe

    whole, short = bpe.from_ranks.__wrapped__(bpe.MULTI_RANKS), bpe.from_ranks.__wrapped__(bpe.MULTI_RANKS)
    assert short._most <= 150_000 < bpe.from_json(bpe.GPT_JSON)._most
    short._most = 20
    texts = [" ".join(f"word{i * k % 97} 'twas {i}" for i in range(30)) for k in range(12)]
    assert [short.encode([t])[0] for t in texts] == whole.encode(texts)
    assert len(short._first) + len(short._spaced) < len(whole._first) + len(whole._spaced)


def test_chunks_met_first_are_encoded_without_ids_between_them():
    """What the library is given adds up to the text's own ids, and every text's ids are the library's."""
    t, c = PLAIN, bpe.from_json.__wrapped__(bpe.GPT_JSON)
    given = []

    def counted(encode):
        def run(text):
            given.append(encode(text))
            return given[-1]

        return run

    for name in ("_one", "_plain_text"):
        if getattr(c, name, None):
            setattr(c, name, counted(getattr(c, name)))
    text = " ".join(f"w{i}" if i % 3 else "äx" + "ab" * (i // 3 % 40) + chr(97 + i % 26) + ".\nNo" + "st" * (i // 120) for i in range(3000))
    want = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(c.encode([text])[0], bpe.ID).tolist() == want
    assert sum(map(len, given)) <= len(want)
    odd = ["", None, " ", "  two  of\n\nthem ", "a<|endoftext|> b.<|endoftext|>", "it's we'll.\nnow!? x², ×y ȑ", "end \n", "tab\tin it\x1c, 中 文。", "\0 \0a Wort.\nWort, Wort"]
    for _ in range(2):
        got = [np.frombuffer(x, bpe.ID).tolist() for x in c.encode(odd)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in odd]


def test_token_file_blocks_of_narrow_and_wide_ranks():
    for n in (0, 1, 200, 300, 70_000):
        ids = np.concatenate([np.arange(n), np.arange(n) // 2]).astype(bpe.ID)
        table, control, data = token_files.encode_ids(ids)
        assert (token_files.decode_ids(len(ids), table, control, data) == ids).all()


def test_ids_of_a_rank_file_decode_without_its_encoder(monkeypatch):
    """The decoding worker held a second encoder beside the encoding one's."""
    ids = bpe.codec(bpe.MULTI_RANKS).encode(["naïve 東京 twice twice"])[0]
    monkeypatch.setattr(bpe, "from_ranks", None)
    assert bpe.decoder(bpe.MULTI_RANKS)(ids).decode() == "naïve 東京 twice twice"


def test_chunks_are_looked_up_once_a_batch():
    """Every chunk of every text was looked up alone; what is met again later stays remembered."""
    c = bpe.from_json.__wrapped__(bpe.GPT_JSON)
    looked, find = [], bpe.Chunks.find
    c._spaced.find = lambda words, turn: looked.append(len(words)) or find(c._spaced, words, turn)
    texts = ["x " + "same words again " * 500, "", None, "y same  words\n", "z again"]
    got = c.encode(texts)
    assert got == [u32(PLAIN.encode(t or "", add_special_tokens=False).ids) for t in texts] and looked[0] < 8
    c._most = 4
    c.encode(["x again"])
    c.encode(["x new"])
    assert "again" in c._spaced.words.to_pylist() and len(c._spaced) <= 4
    assert c.encode(texts) == got
