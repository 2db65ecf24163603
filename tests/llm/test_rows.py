import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import media, sharding, token_files, tokenization
from tessella.llm.mixing import mix, mixed_documents
from tests.llm.helpers import AWKWARD, table, words5

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["It's, A.B, c..d x! ÉTÉ 12,5. '?' \x1c á ,", "!! ?? . , a., B,; 　x y\tz", "", " ", "İ. I. ǅ. ß,", "á ́b 'S 're"]


def expected_mix(rows):
    sized = [(i, s, len(words5(t))) for i, t, s in rows]
    sources = {}
    for _, s, n in sized:
        sources[s] = sources.get(s, 0) + n
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sources.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sources[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sources[s]
            left -= target[s]
        open_ -= over
    return sized, sources, target


@pytest.mark.parametrize("range_rows", [2, 20_000])
def test_mix_meets_budgets(spark, range_rows):
    found = mix(table(spark, clash=("key", "s", "range", "size")), range_rows=range_rows).collect()
    sized, sources, target = expected_mix([(r[0], r[1], r[3]) for r in AWKWARD])
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id) == sorted((i, n) for i, _, n in sized if i)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    by = {}
    for r in found:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s, total in sources.items():
        assert sum(by[(total, round(target[s], 6))]) == int(target[s] + 1e-9)
    assert mix(table(spark, [])).collect() == []


def test_mix_does_not_depend_on_ranges_and_is_expanded(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 7 + 1)), "en", f"s{i % 5}", 1) for i in range(200)]
    a, b = (sorted(map(tuple, mix(table(spark, rows), range_rows=n).collect())) for n in (3, 1000))
    assert a == b
    taken = {r[0]: r[4] for r in a}
    words = {}
    for r in mixed_documents(table(spark, rows)).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("range_rows", [2, 20_000])
def test_mixed_documents_hold_the_words_taken_of_null_and_repeated_ids(spark, range_rows):
    rows = [(*r[:3], r[3] or "none", r[4]) for r in AWKWARD]
    rows += [(5, "another text of id five", "de", "b", 1), (None, "a null id too", "de", "b", 1)]
    _, sources, target = expected_mix([(r[0], r[1], r[3]) for r in rows])
    found = mixed_documents(table(spark, rows), range_rows=range_rows).collect()
    words = {}
    for r in found:
        words[r.source] = words.get(r.source, 0) + len(words5(r.text))
    assert words == {s: int(t + 1e-9) for s, t in target.items() if t}
    taken = {}
    for r in mix(table(spark, rows), range_rows=range_rows).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    by_id = {}
    for r in found:
        by_id[r.doc_id] = by_id.get(r.doc_id, 0) + len(words5(r.text))
    assert by_id == {i: n for i, n in taken.items() if n} and by_id[None] > 0 and by_id[5] > 0
    again = mixed_documents(table(spark, rows).repartition(3), range_rows=range_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_shards_are_even_gapless_and_reproducible(spark):
    df = table(spark, clash=("size", "row_number", "place"))
    rows = sharding.shard(df, shards=3).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(AWKWARD)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard(df.repartition(5), shards=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by_id = {r.doc_id: r for r in rows}
    text = AWKWARD[-1][1].encode()
    assert (by_id[10].size, by_id[10].text_crc32) == (len(text) + 1, zlib.crc32(text))
    assert (by_id[3].size, by_id[3].text_crc32) == (1, 0)
    assert sharding.shard(table(spark, [])).collect() == []


def plain_place(row, total, key=sharding.KEY, rounds=sharding.ROUNDS):
    """The permutation in plain integers."""
    half = 1
    while 4**half < total:
        half += 1
    low, keys = (1 << half) - 1, [int(k) for k in np.random.default_rng(key).integers(0, 2**32, rounds, dtype=np.uint64)]
    while True:
        left, right = row >> half, row & low
        for k in keys:
            h = ((right ^ k) * 0x9E3779B1) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x85EBCA77) & 0xFFFFFFFF
            left, right = right, left ^ ((h ^ (h >> 13)) & low)
        row = (left << half) | right
        if row < total:
            return row


def test_shard_and_slot_follow_from_the_row_number(spark):
    rows = [(i, f"text {i}", None, None, None) for i in range(137)] + [(None, "same", None, None, None)] * 6
    for r in sharding.shard(table(spark, rows), shards=5).collect():
        place = plain_place(r.row_number, len(rows))
        assert (r.shard, r.slot) == (place % 5, place // 5)


def test_counts_with_clashing_columns(spark):
    df = table(spark, clash=("n_bytes", "n_tokens", "over_limit", "doc"))
    found = tokenization.count_tokens(df, BYTE)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and found.count() == len(AWKWARD)


@pytest.mark.parametrize("total", [1, 2, 3, 8, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(total):
    rows = np.arange(total)
    there = sharding.permuted(rows, total)
    assert sorted(there) == list(range(total))
    assert (sharding.permuted(there, total, inverse=True) == rows).all()


def test_global_rows_over_many_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("text_crc32"))
    few, many = (sorted(map(tuple, sharding.global_rows(df, ["doc_id"], n).collect())) for n in (7, 10**6))
    assert few == many and sorted(r[2] for r in few) == list(range(500))


def test_cached_encoder_equals_library(spark, sf_dir):
    library = Tokenizer.from_file(WORD)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    for most in (50, 10**6):
        encoder = tokenization.CachedEncoder(WORD, most)
        for some in (texts, ["<|STARTOFTEXT|>hello,", "a <|endoftext|>B"], texts):
            counts, ids = encoder.encode(pa.array(some))
            want = [library.encode(t, add_special_tokens=False).ids for t in some]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("path", [BYTE, public_tokenizers.path("piece_bpe_32k.model")])
def test_counts_equal_library(spark, path):
    texts = [r[1] or "" for r in AWKWARD] + ODD + ["x" * 5000, " a" * 4000, "word  two\n three " * 500]
    df = table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)] + [(99, None, None, None, None)])
    found = {r.doc_id: r for r in tokenization.count_tokens(df, path, batch_bytes=3000).collect()}
    library = tokenization.load(path)
    for i, text in enumerate(texts):
        want = len(tokenization._encode(library, [text])[0])
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (want, len(text.encode()), want > 1024)
    assert (found[99].n_tokens, found[99].n_bytes) == (0, 0)
    assert tokenization.count_tokens(table(spark, []), path).collect() == []


def test_counter_forgets_and_stays_right(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    counter, library = tokenization.Counter(BYTE, 500, most=40), tokenization.load(BYTE)
    for _ in range(2):
        for text in texts:
            assert counter.count([text, ""]) == [len(library.encode(text, add_special_tokens=False).ids), 0]


def test_segments_join_to_the_text():
    text = "one two  three\nfour five " * 40
    parts = tokenization.segments(text)
    assert "".join(parts) == text and len(parts) > 5


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint64).astype("<u4")
    assert (token_files.from_planes(token_files.to_planes(ids, planes), len(ids), planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_hold_every_id_in_order(spark, planes):
    manifest = token_files.write_token_files(table(spark, clash=("part", "file")), WORD, planes=planes, file_docs=4)
    found = token_files.read_token_files(manifest).collect()
    library, start = Tokenizer.from_file(WORD), 0
    want = []
    for doc, text in sorted(((r[0], r[1]) for r in AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    row = max(manifest.collect(), key=lambda r: r.ids)
    with open(row.file, "rb") as f:
        reader = token_files.Reader(f, row.bytes)
        pieces = [np.concatenate(p) for _, p in reader.documents()]
        assert all((reader.document(i) == p).all() for i, p in enumerate(pieces))
    assert token_files.token_file_digest(table(spark, []), WORD).collect() == []


def test_media_round_trip(spark):
    found = {r.doc_id: r for r in media.media_digest(table(spark, clash=("media", "n_bytes"))).collect()}
    for doc, text, *_ in AWKWARD:
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = found[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
    assert found[1].media_sha256 != found[2].media_sha256 and found[5].feature == found[6].feature
    assert media.media_digest(table(spark, [])).collect() == []


def test_index_media_reads_nested_tables_and_survives_bad_files(spark):
    big = media.pack_payload(bytes(range(64)) * 700)
    odd = media.full_box(b"stz2", b"\0\0\0\x07\0\0\0\3", bytes(8))
    for kind in (b"stbl", b"minf", b"mdia", b"trak", b"moov"):
        odd = media.box(kind, odd)
    rows = [(1, big), (2, None), (3, b""), (4, big[:200]), (5, b"\0\0\0\x04free"), (6, media.box(b"moov")), (7, odd)]
    found = {r.doc_id: r for r in media.index_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert (found[1].codec, found[1].samples, found[1].duration, found[1].timescale) == ("raw ", 700, 700, 25)
    assert len(found[1].keyframes) == 44
    first = found[1].keyframes[1]
    assert big[first.offset : first.offset + first.size] == bytes(range(64))
    assert all(found[k].codec is None and found[k].error for k in (2, 3, 4, 5, 6, 7))


def test_tracks_and_fragments_are_indexed(spark):
    """An audio track first, then a video whose samples lie in two fragments; their bytes are found again."""
    def trak(number, handler, codec):
        head = media.full_box(b"tkhd", bytes(8), number.to_bytes(4, "big"), bytes(68))
        entry = media.full_box(b"stsd", b"\0\0\0\1", media.box(codec, bytes(36)))
        return media.box(b"trak", head, media.box(
            b"mdia", media.full_box(b"mdhd", bytes(8), (90).to_bytes(4, "big"), bytes(8)),
            media.full_box(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", media.box(b"stbl", entry))))

    def fragment(sizes, first_key):
        words = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
        def moof(offset):
            run = media.full_box(b"trun", words(len(sizes), offset, 0 if first_key else 1 << 16), words(*sizes), flags=0x205)
            return media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", words(2, 1 << 16), flags=0x20020), run))
        return moof(len(moof(0)) + 8) + media.box(b"mdat", bytes(range(sum(sizes))))

    trex = media.box(b"mvex", media.full_box(b"trex", (2).to_bytes(4, "big"), (1).to_bytes(4, "big"), (3).to_bytes(4, "big"), bytes(8)))
    data = media.box(b"moov", trak(1, b"soun", b"mp4a"), trak(2, b"vide", b"avc1"), trex) + fragment([5, 7], True) + fragment([4, 6, 9], False)
    rows = media.index_media(spark.createDataFrame([(1, data)], "doc_id long, media binary")).orderBy("track").collect()
    assert [(r.track, r.handler, r.codec, r.samples, r.duration, r.error) for r in rows] == [
        (1, "soun", "mp4a", 0, 0, None), (2, "vide", "avc1", 5, 15, None)]
    assert [data[k.offset : k.offset + k.size] for k in rows[1].keyframes] == [bytes(range(5))]
    track = media.tracks(data)[1]
    assert media.payload(data, track) == bytes(range(12)) + bytes(range(19))
    bad = media.index_media(spark.createDataFrame([(1, data[:-3])], "doc_id long, media binary")).first()
    assert bad.codec is None and bad.error


def test_keyframes_of_stored_texts_are_byte_ranges(spark):
    text = "x" * 64 * 40
    row = media.media_digest(table(spark, [(1, text, None, None, None)])).first()
    stored = media.pack_payload(text.encode())
    assert (row.codec, row.duration, row.timescale, len(row.keyframes)) == ("raw ", 40, 25, 3)
    assert all(stored[k.offset : k.offset + k.size] == b"x" * 64 for k in row.keyframes)


def test_compact_sizes_and_wide_offsets():
    payload = b"abcdefghij"
    stbl = media.box(
        b"stbl", media.full_box(b"stsd", b"\0\0\0\1", media.box(b"mp4a", bytes(8))),
        media.full_box(b"stz2", b"\0\0\0\4\0\0\0\3", bytes([0x23, 0x50])),
        media.full_box(b"stsc", b"\0\0\0\2", b"\0\0\0\1\0\0\0\2\0\0\0\1", b"\0\0\0\2\0\0\0\1\0\0\0\1"),
        media.full_box(b"co64", b"\0\0\0\2", (8).to_bytes(8, "big"), (13).to_bytes(8, "big")),
    )
    data = media.box(b"mdat", payload) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))
    (track,) = media.tracks(data)
    assert track["codec"] == "mp4a" and track["sizes"].tolist() == [2, 3, 5] and media.payload(data, track) == payload
    assert track["keys"].tolist() == [0, 1, 2]


@pytest.mark.parametrize("most", [1, 7, 40, 10**6])
def test_gathered_batches_keep_rows_and_words(most):
    from tessella.llm.arrowtext import ALNUM, gathered, text_array, words

    texts = ["Foo bar", None, "", "É-x 12", "long " * 9, "z"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(texts[:3])], ["i", "t"]), pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(texts[3:])], ["i", "t"])]
    out = list(gathered(iter(batches), most))
    assert [t for b in out for t in b.column(1).to_pylist()] == texts
    assert most > 40 or len(out) > 1
    found = []
    for b in out:
        counts, codes, distinct = words(text_array(b.column(1)), ALNUM)
        found += [distinct[int(c)].as_py() for c in codes]
        assert len(counts) == b.num_rows
    assert found == ["foo", "bar", "É", "x", "12", *["long"] * 9, "z"]


def test_mixed_documents_keep_clashing_columns(spark):
    names = ("mix_take", "mix_row", "mix_whole", "mix_part", "mix_sum", "key", "range", "taken")
    rows = [(i, f"a b c d e {i}", "en", f"s{i % 2}", 1) for i in range(20)]
    found = mixed_documents(table(spark, rows, clash=names))
    assert found.columns[-len(names):] == list(names)
    assert {tuple(r) for r in found.select(*names).collect()} == {("clash",) * len(names)}


def test_a_hot_null_id_is_dealt_to_many_ranges(spark):
    rows = [(None, f"text {i}", "en", "a", 1) for i in range(400)]
    few, many = (sorted(map(tuple, mix(table(spark, rows), range_rows=n).collect()), key=str) for n in (10, 10**6))
    assert few == many and sum(r[4] for r in few) == 1200
    keys = table(spark, rows).select(F.md5(F.concat(F.lit("mix::"), F.md5("text"))).alias("key")).distinct().count()
    assert keys == 400


def test_texts_without_spaces_are_not_remembered(spark):
    """Long pieces leave the caches after their batch: memory doesn't grow with such texts."""
    library, byte_library = Tokenizer.from_file(WORD), tokenization.load(BYTE)
    encoder, counter = tokenization.CachedEncoder(WORD, 1000), tokenization.Counter(BYTE, most=1000)
    sizes = []
    for k in range(6):
        texts = ["".join(chr(0x4E00 + (i * 7 + k * 131 + j) % 5000) for i in range(900)) + f" short{k} end." for j in range(4)] + ["x" * 49, "y" * 48]
        for _ in range(2):
            counts, ids = encoder.encode(pa.array(texts))
            want = [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
            assert counter.count(texts) == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in texts]
        sizes.append((len(encoder.flat), sum(map(len, encoder.place)), sum(map(len, counter.known))))
    assert all(len(p) <= tokenization.PIECE_CHARS for p in [*encoder.place, *counter.known])
    assert sizes[-1][0] < 5000 and sizes[-1][1] < 300 and sizes[-1][2] < 300
