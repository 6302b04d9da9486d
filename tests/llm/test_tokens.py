import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import pyarrow as pa

from pagetrail.llm import bpe, mixing, packing, token_files, tokens
from pagetrail.llm.shared import TOKENIZER_JSON, TOKENIZER_RANKS, table

JSON, RANKS = public_tokenizers.path(TOKENIZER_JSON), public_tokenizers.path(TOKENIZER_RANKS)
ODD = ["", "a\n\nb", "a  b", "\n a", "a \n b", "don't  'll", "a\tb c", " lead", "trail ", "\n", "a\x1cb c", "é ñ", "<|endoftext|> a", "a" * 5000, "ab" * 3000, "日本語 " * 50, "a\u00a0b c", "a \u2003b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def texts(spark, small):
    return [r.text for r in table(spark, small, "documents").collect()] + ODD + [None]


def lists(own, texts):
    ids, ends = own.ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def random_texts(n, more=()):
    rng = random.Random(1)
    parts = [" ", "\n", "\t", "a", "b", "'s", "'", ".", "1", "é", "\u00a0", "\u2003", "日", "!!", "\x85", "_", "\r", *more]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_segments_are_the_whole(texts, library):
    own = tokens.LibrarySegments(JSON, remembered=500)
    texts = texts + random_texts(3000)
    want = [library(text) for text in texts]
    for _ in range(2):  # the second time with some segments remembered
        assert lists(own, texts) == want
    assert lists(own, []) == [] and lists(own, [None, ""]) == [[], []] and len(own.known) == 500
    assert lists(own, [None, "a", *texts, "b"])[2:-1] == want


def test_plain_segments_are_encoded_many_to_a_text(library):
    own = tokens.encoder(JSON)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghé'1日.,_") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    segments = [" " + w for w in words] + ["a", " ", "  b", "\n", " c ", " d\u00a0e", " d\u2003", "", " \x1cf", " \ufffd", " " + "g" * 5000]
    rng.shuffle(segments)
    asked, each = [], own.each

    def counted(texts):
        asked.extend(texts)
        return each(texts)

    own.each = counted
    try:
        assert [np.frombuffer(x, "<u4").tolist() for x in own.many([s.encode() for s in segments])] == [library(s) for s in segments]
        assert len(asked) < 100
        added = [" x", " <|endoftext|>", " y<|endoftext|>z", " w"]  # those of an added token are not
        assert [np.frombuffer(x, "<u4").tolist() for x in own.many([s.encode() for s in added])] == [own.tokenizer.encode(s, add_special_tokens=False).ids for s in added]
    finally:
        del own.each


def test_added_tokens_are_those_of_the_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = ["a b c", "a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|>\nb <|endoftext|>", "a  <|endoftext|>", "<|endoftext |> a", "d e", *random_texts(500, ["<|endoftext|>"])]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[1] == [64, 220, 50256, 275]
    assert lists(tokens.encoder(JSON), texts) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_files.read_files(token_files.write_files(docs, f"file://{tmp_path}/t", JSON), with_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [[*ids, 0] for ids in want]
    assert [r.start for r in rows] == np.cumsum([0, *(len(ids) + 1 for ids in want[:-1])]).tolist()
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, JSON).collect()}
    assert packed == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(want)}


def test_other_vocabularies_are_encoded_text_by_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokens.LibrarySegments(path, special=True)
    texts = ["Words in  it", "a.b c", ""]
    assert not own.cuts and lists(own, texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe(texts, reference):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, remembered=500)
    rng = random.Random(1)
    texts = texts + ["".join(rng.choice("abcdefgh ") for _ in range(20_000)), "".join(rng.choice("aab") for _ in range(20_000)), *random_texts(3000)]
    for text, ids in zip(texts, lists(codec, texts), strict=True):
        assert ids == reference(text or "")
        assert bytes(codec.decode(np.array(ids, np.uint32))[0]) == (text or "").encode()
        assert bytes(codec.decimal(np.array(ids, np.uint32))[0]).decode() == "".join(f"{i} " for i in ids)


def test_op7(spark, small, reference):
    got = {r.doc_id: r for r in bpe.op7_bpe_bitmap(spark, small).collect()}
    docs = table(spark, small, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference(d.text)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_bpe_frames(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, None, 2), (1, "a b", 3)], "doc_id long, text string, ids int")
    back = bpe.decoded(bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back.collect()), key=repr) == [(1, b"a b"), (1, b"a b"), (None, b"")]
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def prior_of(ids):
    return token_files.unpacked_prior(token_files.packed_prior(ids))


@pytest.mark.parametrize("n,block", [(1, 512), (700, 512), (5000, 512), (1024, 512), (3000, 4096)])
def test_coder(n, block):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50_257, rng.integers(0, 65_536, n), np.full(n, 65_535), np.zeros(n, np.int64), np.arange(n) % 3, np.r_[np.zeros(n, np.int64), 7]):
        assert (mixing.decode(mixing.encode(ids, block, prior_of(ids)), len(ids), block, prior_of(ids)) == ids).all()


def test_coded_bytes_are_those_of_earlier_files():
    ids = np.r_[np.random.default_rng(5).zipf(1.3, 20_000) % 50_257, np.tile(np.arange(300), 20)]
    assert zlib.crc32(b"".join(mixing.encode(ids, 512, prior_of(ids)))) == 4184591638


def test_guesses_of_both_orders_are_looked_up_at_once():
    class Counted(np.ndarray):
        takes = 0

        def take(self, *a, **how):
            Counted.takes += 1
            return np.asarray(self).take(*a, **how)

    models = mixing.Models(600, prior_of(np.arange(100)))
    models.places = models.places.view(Counted)
    models.begin()
    assert models.guess.shape == (2, 600) and Counted.takes == 1


def test_coder_with_every_id():
    ids = np.random.default_rng(0).permutation(np.r_[np.arange(65_536), np.zeros(200_000, np.int64)])
    assert (mixing.decode(mixing.encode(ids, 512, prior_of(ids)), len(ids), 512, prior_of(ids)) == ids).all()


def test_blocks_are_independent():
    ids = np.random.default_rng(0).zipf(1.3, 6000) % 50_257
    prior, coded = prior_of(ids), mixing.encode(ids, 512, prior_of(ids))
    for k in (0, 5, len(coded) - 1):
        part = ids[512 * k : 512 * (k + 1)]
        assert (mixing.decode([coded[k]], len(part), 512, prior) == part).all()


def test_coder_learns_repeats():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 50), 80)
    assert sum(map(len, mixing.encode(ids, 4096, prior_of(ids)))) * 8 / len(ids) < 1


def test_coder_takes_less_than_order_0_and_zlib(spark, middle):
    ids, _ = tokens.encoder(JSON).ids(table(spark, middle, "documents").orderBy("doc_id").select("text").toArrow().column("text").combine_chunks())
    ids = ids[:600_000]
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    size = len(written([(0, ids)])) * 8 / len(ids)  # the whole file: prior, blocks, directory
    assert size < 0.98 * entropy and size < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    assert token_files.block_size(1) == 512 and token_files.block_size(token_files.GROUP) == token_files.MOST


def test_ids_beyond_16_bits_are_refused():
    assert written([(1, [65_535])])
    with pytest.raises(ValueError):
        written([(1, [3, 65_536])])


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def written(docs):
    f = io.BytesIO()
    w = token_files.Writer(f)
    for doc_id, ids in docs:
        w.add([doc_id], [len(ids)], np.array(ids, np.uint32))
    w.close()
    return f.getvalue()


def test_file(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 1000)
    rng = np.random.default_rng(0)
    docs = [(k if k % 5 else None, rng.integers(0, 50_257, n).tolist()) for k, n in enumerate([1, 999, 1, 2500, 3, 0, 1200])]
    data = written(docs)
    assert [(i, x.tolist()) for i, x in token_files.read_file(Bytes(data), len(data))] == docs
    assert list(token_files.read_file(Bytes(written([])), len(written([])))) == []
    for at in (20, len(data) - 20):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises((ValueError, zlib.error)):
            list(token_files.read_file(Bytes(broken), len(broken)))


def test_op5(spark, small, library):
    got = token_files.op5_context_mixing(spark, small).orderBy("doc_id").collect()
    start, want = 0, []
    for d in table(spark, small, "documents").orderBy("doc_id").collect():
        ids = np.array([*library(d.text), 0], "<u4")
        want.append((d.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_odd_rows(spark, tmp_path, library):
    docs = spark.createDataFrame([(2, "b", 0), (1, None, 0), (None, "", 0), (2, "a", 0), (2, "a", 0)], "doc_id long, text string, start int")
    rows = token_files.read_files(token_files.write_files(docs, f"file://{tmp_path}/t", JSON), with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in rows] == [(None, [0]), (1, [0]), (2, [*library("a"), 0]), (2, [*library("a"), 0]), (2, [*library("b"), 0])]
    assert token_files.read_files(token_files.write_files(docs.limit(0), f"file://{tmp_path}/e", JSON)).count() == 0


def test_files_end_after_so_many_tokens(spark, tmp_path, monkeypatch):
    class Rows:
        sparkSession = spark

        def same(self, *_):
            return self

        select = repartitionByRange = sortWithinPartitions = same

        def mapInArrow(self, run, _):
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(token_files, "TaskContext", Task)
    monkeypatch.setattr(token_files, "FILE", 6)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k, None], "text": ["a b c d", None]}) for k in range(4)]
    made = pa.Table.from_batches(token_files.write_files(Rows(), f"file://{tmp_path}/t", JSON)(batches)).to_pylist()
    assert [(r["part"], r["number"], r["tokens"], r["documents"]) for r in made] == [(3, k, 6, 2) for k in range(4)]
    rows = token_files.read_files(spark.createDataFrame(made[::-1]), with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [x for k in range(4) for x in ((k, 6 * k, 5), (None, 6 * k + 5, 1))]


def check_runs(counts, capacity):
    runs, seen, content = packing.best_fit(counts, capacity), set(), {}
    for length, a, b, sequence, offset in runs:
        for r in range(a, b):
            assert (length, r) not in seen
            seen.add((length, r))
            content.setdefault(sequence + r - a, []).append((offset, length))
    assert seen == {(n, r) for n, c in counts.items() for r in range(c)} and set(content) == set(range(len(content)))
    for places in content.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(content)


def one_by_one(counts, capacity):
    spaces = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - n)
        else:
            spaces.append(capacity - n)
    return len(spaces)


def test_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 50, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        assert check_runs(counts, capacity) == one_by_one(counts, capacity)
    assert packing.best_fit({}) == []


def test_op10(spark, small, library):
    got = packing.op10_best_fit_packing(spark, small).collect()
    docs = {d.doc_id: [*library(d.text), 0] for d in table(spark, small, "documents").collect()}
    pieces, places = {}, {}
    for r in got:
        ids = np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, ids in docs.items():
        assert [(p[1], p[2]) for p in sorted(pieces[doc_id])] == packing.cut(len(ids), 2048)
    for v in places.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(5, 2048) == [(0, 5)] and packing.cut(2049, 2048) == [(0, 1), (1, 2048)]


def test_pack_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (2, "word " * 3000, 3)], "doc_id long, text string, length int")
    rows = packing.pack(docs, JSON, capacity=64).collect()
    assert sum(r.length for r in rows if r.doc_id != 2) == 3 and all(r.length <= 64 for r in rows)
    assert packing.pack(docs.limit(0), JSON).count() == 0
