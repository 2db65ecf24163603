import base64
import hashlib
import io
import math
import sys
import zipfile
import zlib
from bisect import bisect_left
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import alignment, archives, whitening
from tests.llm.helpers import AWKWARD, table

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " a  b", "a b▁c d", "x \x00 y", "it's  'tis a 's b\n c \t d  ", "<|endoftext|> hi <s> </s> <unk> <0x0A>", "日本語 テキスト" * 50, "　a 　 b",
    "İ ǅ ſ ́a", "a b  c", " ", "  ", "\n", "\x85 a \x85b c\x1c d", "ﬁ ½ ①", "x" * 900, "\r\n x", "🙂🙂 👩‍👩‍👧 a", "12 345 6,7",
]


class Plain:
    """Alignment token by token, with the libraries on whole texts."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = alignment.entry_bytes(BYTE), alignment.entry_bytes(PIECE)

    def spans(self, text):
        raw = f" {text}".encode()
        sides = []
        for ids, names in ((self.a.encode(f" {text}", add_special_tokens=False).ids, self.bytes_a), (self.b.encode(text), self.bytes_b)):
            if b"".join(names[i] for i in ids) != raw:
                return None
            ends = np.cumsum([len(names[i]) for i in ids]).tolist()
            sides.append([(i, s, e) for i, s, e in zip(ids, [0, *ends[:-1]], ends)])
        return sides

    def row(self, text):
        sides = self.spans(text) if text else None
        if not sides:
            return 0, 0, "", []
        a, b = sides
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        inside = [([], []) for _ in cuts]
        for k, side in enumerate(sides):
            for i, _, e in side:
                inside[bisect_left(cuts, e)][k].append(str(i))
        groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in inside)
        links, k = [], 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        return len(a), len(b), groups, links


@cache
def shared_plain():
    return Plain()


@pytest.fixture(scope="module")
def plain():
    return shared_plain()


def test_alignment_equals_a_plain_one(spark, plain):
    rows = [(r[0], r[1], None, None, None) for r in AWKWARD] + [(100 + k, t, None, None, None) for k, t in enumerate(ODD * 2)]
    wanted, count = [], {}
    for doc, text, *_ in rows:
        wanted.append((doc, *plain.row(text)))
        for link in wanted[-1][-1]:
            count[link] = count.get(link, 0) + 1
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    want = sorted(
        (str(doc), a, b, groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == highest[x[1]] for x in links),
         sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for doc, a, b, groups, links in wanted
    )
    found = alignment.align(table(spark, rows, clash=("row", "pair", "count", "n_a")), BYTE, PIECE)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == want
    texts = {r.doc_id: r.groups for r in alignment.aligned_texts(table(spark, rows), BYTE, PIECE).collect()}
    assert texts[105] == plain.row(ODD[5])[2] and texts[3] == texts[4] == texts[101] == ""
    assert alignment.align(table(spark, []), BYTE, PIECE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab éß日 \n\t.,'▁<0>"), max_size=60))
def test_segments_align_as_whole_texts(text):
    own, one = shared_plain(), alignment.worker_aligner(BYTE, PIECE)
    assert one.cuts
    found = one.align([text])[0]
    assert (";".join(x.shown for x in found) if found else "") == own.row(text)[2]


def test_aligner_forgets_and_stays_right(plain, sf_dir, spark):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    one = alignment.Aligner(BYTE, PIECE, most=30)
    for _ in range(2):
        for found, text in zip(one.align(texts), texts):
            assert (";".join(x.shown for x in found) if found else "") == plain.row(text)[2]
        assert len(one.known) <= 30 and all(len(p) <= alignment.SEGMENT_CHARS for p in one.known)


def test_segments_are_small_and_give_each_text_its_numbers(plain):
    texts = [*ODD, "one two  three", "ab cd", ""]
    found = alignment.Aligner(BYTE, PIECE).align(texts)
    sums, links, pairs = alignment.unpacked(found)
    groups = [plain.row(t)[2] for t in texts]
    assert sums[2].tolist() == [g.count(";") + 1 if g else 0 for g in groups] and links.sum() == len(pairs)
    assert [len(p) for p in sums[:2]] == [len(texts)] * 2
    for side in (0, 1):
        assert sums[side].tolist() == [sum(x.split("|")[side].count(",") + 1 for x in g.split(";")) if g else 0 for g in groups]
    assert all(sys.getsizeof(x) + sum(map(sys.getsizeof, x)) < 500 for x in found[-2])


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1), st.integers(0, 300))
def test_bits_rank_and_select(places, at):
    bits = alignment.Bits.at(np.array(sorted(places)), 301)
    assert bits.select().tolist() == sorted(places)
    assert bits.rank(np.array([at])).tolist() == [sum(p < at for p in places)]


# Whitening


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, component string, vector string, n string")


def exact(rows):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows], object)
    y = len(x) * x - x.sum(axis=0)
    return y, y.T @ y


def test_scatter_is_exact_and_whitening_holds(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(700, 12)) * np.geomspace(1, 400, 12)).astype(np.float32).tolist()
    rows = [(k % 650 if k % 50 else None, v, "c", "v", "n") for k, v in enumerate(good)]
    bad = [None, [], [1.0] * 11 + [None], [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1.0] * 3]
    df = vectors(spark, rows + [(9000 + k, v, None, None, None) for k, v in enumerate(bad)])
    y, scatter = exact(good)
    for partitions in (1, 5):
        model = whitening.fit_whitening(whitening.clean(df.repartition(partitions), "vec_id", "embedding"))
        assert (model.scatter == scatter).all()
    found = whitening.whitening(df).collect()
    assert len(found) == 8 * len(good) and {r.n for r in found} == {700}
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    covariance = np.array(scatter / 700**3, float)
    values, columns = np.linalg.eigh(covariance)
    mine = sorted((-1 if r[0] is None else r[0], int((v * v).sum())) for r, v in zip(rows, y))
    assert sorted({(-1 if i is None else i, d) for i, d in by_row}) == sorted(set(mine))
    for k in range(8):
        at = np.argsort(values)[::-1][k]
        wanted = np.array(y / 700, float) @ columns[:, at] / np.sqrt(values[at])
        got = [r.whitened for r in found if r.component == k + 1]
        assert min(np.abs(np.sort(got) - np.sort(s * wanted)).max() for s in (1, -1)) < 1e-8
        share = {r.explained for r in found if r.component == k + 1}
        assert len(share) == 1 and abs(share.pop() / (values[at] / np.trace(covariance)) - 1) < 1e-9
    assert {r.identity_error for r in found} and found[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whitening(vectors(spark, [])).collect() == []
    assert whitening.whitening(vectors(spark, [(1, None, None, None, None), (2, [], None, None, None)])).collect() == []
    one = whitening.whitening(vectors(spark, [(1, [0.5, 2.0], None, None, None)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    flat = whitening.whitening(vectors(spark, [(k, [float(k), 3.0], None, None, None) for k in range(5)] * 2)).collect()
    assert len(flat) == 20 and all(r.identity_error < 1e-12 for r in flat) and all(r.whitened == 0 for r in flat if r.component == 2)


def test_large_entries_stay_exact(spark):
    good = [[1e15 * k, -3e15 + k, 0.5 * k] for k in range(9)]
    y, scatter = exact(good)
    df = vectors(spark, [(k, v, None, None, None) for k, v in enumerate(good)])
    assert (whitening.fit_whitening(whitening.clean(df, "vec_id", "embedding")).scatter == scatter).all()
    found = {r.vec_id: r.deviation for r in whitening.whitening(df).collect()}
    assert found == {k: None if v >= 2**63 else v for k, v in enumerate((row * row).sum() for row in y)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**60), 2**60), min_size=3, max_size=3), min_size=1, max_size=30))
def test_residues_give_back_any_scatter(rows):
    y = np.array(rows, np.int64)
    want = y.astype(object).T @ y.astype(object)
    moduli = whitening.primes(2 * max(1, int(np.abs(want).max())))
    assert all(p < 2**20 and all(p % k for k in range(2, 1025)) for p in moduli) and len(set(moduli)) == len(moduli)
    assert (whitening.remaindered([whitening.residue_scatter(y, p) for p in moduli], moduli) == want).all()


# Archives

PAGES = "page_id long, url string, html string, digest string, size string"
HTML = "<html>é 你好</html>"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_archives_give_back_every_page(spark):
    rows = [(7, "http://a/1", HTML), (3, "http://a/2", HTML), (None, None, HTML), (3, "http://a/2", HTML), (4, "u\r\nX: y é", None), (5, "", ""), (6, "u", "x" * 300_000), (8, "u", "\r\n\r\n\0"),
            (None, "u", "only null"), (None, "u", "only null"), (9, "u", "single")]
    df = spark.createDataFrame([(*r, "d", "s") for r in rows], PAGES).repartition(3)
    found = archives.archive_digest(df)
    assert all(r.error is None for r in found.collect())
    got = sorted(map(str, (tuple(r)[:5] for r in found.collect())))
    want = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        again = first is not None and page != first
        want.append(str((page, len((html or "").encode()), sha(html or ""), "revisit" if again else "response", first if again else None)))
    assert got == sorted(want)
    kept = archives.archive_digest(df, least_bytes=100).collect()
    assert {r.record_type for r in kept} == {"response"} and len(kept) == len(rows)
    assert archives.archive_digest(spark.createDataFrame([], PAGES)).collect() == []


def test_packages_are_zip_files_and_records_are_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://a/{k}", f"page {k % 3}", "", "") for k in range(9)], PAGES)
    manifest = archives.write_packages(df.coalesce(1), f"file://{tmp_path}/out")
    row = manifest.first()
    with zipfile.ZipFile(row.file) as z:
        assert z.testzip() is None and z.namelist() == [archives.RECORDS, archives.INDEX, archives.PACKAGE]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        raw = z.read(archives.RECORDS)
    whole, rest = b"", raw
    while rest:
        one = zlib.decompressobj(31)
        whole, rest = whole + one.decompress(rest), one.unused_data
    assert whole.count(b"WARC/1.1\r\n") == 9 and whole.count(b"WARC-Type: revisit") == 6
    for small in (1, 100, 1 << 20):
        found = archives.read_records(archives.record_ranges(archives.list_members(manifest)), range_bytes=small).collect()
        assert sorted(bytes(r.payload) for r in found if r.type == "response") == [b"page 0", b"page 1", b"page 2"] and len(found) == 9
    pages = [r for r in found if r.type == "revisit"]
    assert all(r.size is None and r.refers.startswith("urn:page:") for r in pages)


def other_package(path, lines, method=zipfile.ZIP_STORED, comment=b"", records=b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"):
    with zipfile.ZipFile(path, "w", method) as z:
        with z.open(archives.RECORDS, "w", force_zip64=True) as f:
            f.write(records)
        z.writestr(archives.INDEX, lines)
        z.comment = comment


def test_other_packages_are_read_and_broken_ones_named(spark, tmp_path):
    n = len(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    good = f'org,a)/ 2020 {{"offset": "0", "length": {n}, "filename": "data.warc.gz"}}\n'
    other_package(tmp_path / "good", good, comment=b"a comment PK\x05\x06 with a mark")
    other_package(tmp_path / "line", good + '{"offset": 5, "length": 9999}\nnonsense\n')
    other_package(tmp_path / "pressed", good, zipfile.ZIP_DEFLATED)
    other_package(tmp_path / "record", good, records=b"x" * 100)
    (tmp_path / "shift").write_bytes(b"#!stub" + (tmp_path / "good").read_bytes())
    (tmp_path / "cut").write_bytes((tmp_path / "good").read_bytes()[:200])
    (tmp_path / "empty").write_bytes(b"")
    names = ["good", "line", "pressed", "record", "shift", "cut", "empty", "gone"]
    rows = [(str(tmp_path / x), f"file://{tmp_path}", (tmp_path / x).stat().st_size if x != "gone" else 99) for x in names]
    packages = spark.createDataFrame(rows, "file string, folder string, bytes long")
    found = archives.read_records(archives.record_ranges(archives.list_members(packages))).collect()
    types = [r.type for r in found if r.error is None]
    assert types == ["warcinfo"] * 3
    # Two bad lines, two pressed members, a bad record, and three files that are no packages.
    assert len([r for r in found if r.error]) == 2 + 2 + 1 + 3


def test_directory_of_many_forms():
    out = io.BytesIO()
    package = archives.Package(out)
    for name, raw in (("a", b"abc"), ("ü/b", b""), ("c", bytes(1000))):
        package.begin(name)
        package.write(raw)
        package.end()
    package.finish()
    data = out.getvalue()
    found = archives.directory(io.BytesIO(data), len(data))
    assert [(m["name"], m["size"], data[m["at"] : m["at"] + m["stored"]]) for m in found] == [("a", 3, b"abc"), ("ü/b", 0, b""), ("c", 1000, bytes(1000))]
    assert all(m["crc"] == zlib.crc32(data[m["at"] : m["at"] + m["stored"]]) for m in found)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == ["a", "ü/b", "c"]
