"""Operators against plain versions, and on nulls, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sori.llm import binary, blocks, bpe, graph, linededup, minhash, neardup_vectors, packing, queries, search, sharding, toxicity, warc
from sori.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASH = "id long, key string, block int, n int, part int, size string, shard int, first int, rank int, v int, component long, lines_removed string, ids int"


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


def edit(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


BASE = prose(1, 300)
DOCS = [
    (1, BASE), (2, BASE), (3, edit(BASE, 7)), (4, prose(2, 300)), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "One TWO"), (10, "naïve café — 東京 😀 <|endoftext|> x's  \n\n  end "),
    (11, prose(3, 12_000)), (None, BASE), (12, prose(4, 40)), (12, prose(4, 40)), (13, "x" * 3000 + " y"), (14, edit(edit(BASE, 9), 200)),
]


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(7).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ") if c.split()[0] not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, none):
    rows = packing.pack(docs, PATH, length=64).collect()
    by_doc = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert by_doc == Counter((d, len(ids_of(t)) + 1) for d, t in DOCS)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
        assert r.offset + r.length <= 64 and crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 64 for s in range(len(fill) - 1))
    spans = sorted((r.sequence_id * 64 + r.offset, r.length) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    pieces = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == 11), key=lambda r: r.start))
    assert np.frombuffer(pieces, "<u4").tolist() == [*ids_of(DOCS[10][1]), 0]
    assert packing.pack(none, PATH).count() == 0


def test_bpe_and_binary(docs, none):
    got = {(r.doc_id, r.decoded): r.ids for r in bpe.encode_decode(docs, PATH).collect()}
    for d, t in DOCS:
        assert got[(d, t or "")] == ids_of(t)
    assert bpe.encode_decode(none, PATH).count() == 0
    rows = sorted(binary.read_tokens(binary.write_tokens(docs, PATH)).collect(), key=lambda r: r.start)
    order = sorted(DOCS, key=lambda d: -1 if d[0] is None else d[0])
    assert [r.doc_id for r in rows] == [d for d, _ in order]
    at = 0
    for r, (_, t) in zip(rows, order, strict=True):
        want = [*ids_of(t), 0]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)
    assert binary.read_tokens(binary.write_tokens(none, PATH)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab tion'sé\n 😀東1 "), max_size=90))
def test_encoders_equal_the_library(text):
    assert np.frombuffer(bpe.bpe(PATH).encode([text])[0], "<u4").tolist() == ids_of(text)
    assert np.frombuffer(Encoder(PATH).encode([text])[0], "<u4").tolist() == ids_of(text)


def test_container_reads_ranges_and_finds_damage(tmp_path):
    from pyarrow.fs import LocalFileSystem

    fs, path = LocalFileSystem(), str(tmp_path / "f.bin")
    big = np.arange(2_500_000, dtype="<u4").tobytes()
    with fs.open_output_stream(path) as out:
        w = binary.Writer(out)
        w.add(5, b"\x01\x00\x00\x00"), w.add(None, big), w.add(7, b"\x02\x00\x00\x00")
        w.finish()
    with fs.open_input_file(path) as src:
        r = binary.Reader(src)
        assert r.index[:, 1].tolist() == [1, 3, 1] and r.ids(1) == big and r.ids(2) == b"\x02\x00\x00\x00"
    raw = bytearray((tmp_path / "f.bin").read_bytes())
    raw[int(r.offset[1]) + 20] ^= 1
    (tmp_path / "f.bin").write_bytes(raw)
    with fs.open_input_file(path) as src, pytest.raises(Exception):
        binary.Reader(src).ids(1)


def jaccard_groups(rows, percent):
    def sh(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(d, sh(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return Counter((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, docs, none, percent):
    r = random.Random(5)
    family = [(100 + i, edit(edit(BASE, r.randrange(300)), r.randrange(300)) if i % 3 else edit(BASE, r.randrange(300))) for i in range(60)]
    rows = DOCS + family
    got = minhash.near_duplicates(frame(spark, rows), percent).collect()
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got if g.doc_id is not None) == jaccard_groups(rows, percent)
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in got)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {2, 3}.isdisjoint({x.doc_id for x in kept.collect()})


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)])
    sig = minhash.superminhash(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [400, 400, 3]), 3, 320)
    assert (sig != minhash.EMPTY).all() and abs((sig[0] == sig[1]).mean() - 0.6) < 0.1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}
    for a, b in edges:
        if a != b:
            group = {x for x in root if root[x] in (root.get(a, a), root.get(b, b))} | {a, b}
            root |= dict.fromkeys(group, min([*group, *(root[x] for x in group if x in root)]))
    assert got == root


def test_warc(spark, none):
    big = "<html>é" + "x" * 1200
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u\r\nX: y", "z" * 999), (7, "u", "z" * 999), (2, "u", big)]
    got = warc.read_archives(warc.write_archives(frame(spark, rows, "page_id long, url string, html string"))).collect()
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = 2 if html == big and page != 2 else None
        want[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers)] += 1
    assert Counter((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got) == want
    assert all(bytes(g.payload) == (rows[[r[0] for r in rows].index(g.page_id)][2] or "").encode() for g in got if g.record_type == "response" and g.page_id in (3, 5, 6))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_zip64_directory(tmp_path):
    import zipfile

    from pyarrow.fs import LocalFileSystem

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(70_000):  # beyond 65,535 members the directory's end is a ZIP64 one
            z.writestr(f"m{i}", b"" if i else b"hello")
    with LocalFileSystem().open_input_file(path) as src:
        index = warc.ZipIndex(src)
        assert len(index.members) == 70_000 and index.range(*index.stored("m0")) == b"hello"


def vectors(spark, rows):
    return frame(spark, rows, "vec_id long, embedding array<float>, label int")


def vector_rows():
    r = np.random.default_rng(1)
    x = r.standard_normal((160, 16)).astype(np.float32) / 4
    x[100:130] = x[70:100] + r.standard_normal((30, 16)).astype(np.float32) * 0.04
    x[130:140] = x[50]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    return rows + [(200, None, 1), (250, [float("nan")] * 16, 1), (300, [None] * 16, 1), (350, [0.0] * 16, 1), (400, x[3].tolist(), None), (None, x[3].tolist(), 0), (3, x[3].tolist(), 0), (450, [], 1), (500, [1.0, 2.0], 1)]


def test_search(spark):
    rows = vector_rows()
    ok = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, _ in rows if i is not None and v and all(y is not None and np.isfinite(y) for y in v)]
    want = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert Counter(map(tuple, search.top_k(vectors(spark, rows)).collect())) == Counter(want)
    assert search.top_k(vectors(spark, [])).count() == 0


def test_embedding_near_duplicates(spark):
    rows = vector_rows()
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    links, root = Counter(), {i: i for i, _, _ in rows if i is not None}
    pairs = [(a[0], b[0]) for a, b in combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93 * np.sqrt((a[1] @ a[1]) * (b[1] @ b[1]))]
    for a, b in pairs:
        links[a] += 1
        if a != b:
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    got = neardup_vectors.near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {g.vec_id: (g.n_links, g.component_id) for g in got if g.vec_id is not None} == {i: (links[i], root[i]) for i in root}
    assert neardup_vectors.near_duplicates(vectors(spark, [])).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in DOCS)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard(none).count() == 0


def test_sharding_deals_equal_rows_apart(spark, docs):
    """600 equal rows among 600 others: their shards and neighbours are as mixed as those of rows that differ."""
    rows = sharding.shard(frame(spark, [(1, "same")] * 600 + [(i, str(i)) for i in range(2, 602)]), 6).collect()
    same = Counter(r.shard for r in rows if r.doc_id == 1)
    assert len(same) == 6 and all(60 <= n <= 140 for n in same.values())
    order = sorted((r.shard, r.slot, r.doc_id == 1) for r in rows)
    runs = sum(a[2] != b[2] for a, b in zip(order, order[1:]))
    assert 500 <= runs <= 700


def test_queries_return_their_columns(spark):
    """Every query runs on small tables and gives the columns of its contract."""
    want = {
        "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_toxicity": "doc_id held_out score predicted", "op3_minhash": "doc_id n_shingles component_id kept",
        "op4_warc": "page_id payload_bytes payload_digest record_type refers_to", "op5_search": "query_id rank vec_id score", "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7_lines": "doc_id lines_kept lines_removed text_sha256", "op8_embeddings": "vec_id n_links component_id kept", "op9_binary": "doc_id start n_tokens ids_crc32", "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op12_substring": "doc_id n_words n_removed kept_sha256", "op11_fim": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op13_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    }
    for name, query in queries.queries().items():
        df = query(spark, "/root/testdata/sf0.001")
        assert set(want[name].split()) <= set(df.columns) and df.count() > 0, name


def test_hypergeometric_law():
    rng = random.Random(4)
    seen = Counter(sharding.hypergeometric(rng, 7, 13, 6) for _ in range(20_000))
    from math import comb

    for k in range(7):
        assert abs(seen[k] / 20_000 - comb(7, k) * comb(13, 6 - k) / comb(20, 6)) < 0.015
    m = sharding.communication_matrix([10, 0, 33, 7], 4, 1)
    assert [sum(x) for x in m] == [10, 0, 33, 7] and sorted(map(sum, zip(*m))) == [12, 12, 13, 13]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_edit_distance(a, b):
    assert linededup.edit_distance(a, b, 99) == levenshtein(a, b)
    assert (linededup.edit_distance(a, b, 3) <= 3) == (levenshtein(a, b) <= 3)


def expected_lines(rows):
    """Texts without repeated lines, by comparing all pairs of lines."""
    found = sorted({(d, t, n, x) for d, t in rows if d is not None and t for n, x in enumerate(linededup.normalise(t)) if linededup.counts(x, linededup.MIN_BYTES)})
    distinct = sorted({x for *_, x in found})
    root = {x: x for x in distinct}
    for a, b in combinations([x for x in distinct if linededup.counts(x, linededup.FUZZY_BYTES)], 2):
        most = int(0.1 * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) <= most and linededup.edit_distance(a.decode(), b.decode(), most) <= most:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    keep = {}
    for d, t, n, x in found:
        keep[root[x]] = min(keep.get(root[x], (d, t, n)), (d, t, n))
    gone = {(d, t, n) for d, t, n, x in found if keep[root[x]] != (d, t, n)}
    return Counter((d, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, t, n) not in gone)) for d, t in rows)


@pytest.mark.parametrize("small", [32, 2])  # with 2, all larger groups are compared with their lead and in blocks
def test_lines(spark, none, monkeypatch, small):
    monkeypatch.setattr(linededup, "SMALL_GROUP", small)
    monkeypatch.setattr(blocks, "BLOCK_AMOUNT", 1000)
    monkeypatch.setattr(blocks, "SMALL_BUCKET", min(small, blocks.SMALL_BUCKET))
    r = random.Random(8)
    lines = [prose(50 + i, 30) for i in range(40)]
    near = [x.replace("alpha", "alphq", 1) for x in lines]
    family = [edit(edit(lines[0], r.randrange(30)), r.randrange(30)) for _ in range(30)]  # not all similar to each other
    rows = [(i, "\n".join([r.choice(lines), prose(900 + i, 20), r.choice(near).upper(), "short line", r.choice(lines) + "!", family[i]])) for i in range(30)]
    rows += [(90, None), (91, ""), (None, lines[0]), (92, lines[0]), (92, lines[0]), (93, "x" * 40_000), (94, "x" * 39_999 + "y")]
    want = expected_lines(rows)
    out = linededup.drop_duplicate_lines(frame(spark, rows))
    assert Counter((x.doc_id, x.text) for x in out.collect()) == want and want != Counter(rows)
    assert linededup.drop_duplicate_lines(none).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, prose(1, 20) + "\n" + prose(2, 20)), (1, prose(3, 20) + "\n" + prose(2, 20)), (2, prose(4, 20) + "\n" + prose(2, 20)), (2, prose(2, 20) + "\n" + prose(5, 20))]
    out = sorted(x.text for x in linededup.drop_duplicate_lines(frame(spark, rows)).collect())
    assert sum(x.count(prose(2, 20)) for x in out) == 1 and all(any(prose(i, 20) in x for x in out) for i in (1, 3, 4, 5))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "dd"]), max_size=9), st.lists(st.sampled_from(["a", "bb", "ccc", "dd"]), max_size=9), st.integers(0, 12))
def test_alignment_by_words_is_an_upper_bound(x, y, most):
    a, b = " ".join(x), " ".join(y)
    assert not linededup.within(a.split(" "), b.split(" "), most) or levenshtein(a, b) <= most
    assert linededup.edit_distance(a * 3, b * 3, most) <= most or levenshtein(a * 3, b * 3) > most


def test_lines_recall(spark):
    """Against brute force over all pairs of lines, without fingerprints: lines at an edit similarity of 0.9 to 0.99."""
    r, rows, pairs = random.Random(5), [], 0
    letters = "etaoinshrdlucmfwyp"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 8)))
    lines = []
    for words in (5, 6, 8, 10, 14, 20, 30, 50, 100) * 12:
        line = " ".join(word() for _ in range(words))
        other = list(line)
        for at in r.sample(range(len(line)), r.randint(1, max(1, int(0.1 * len(line))))):
            if other[at] != " ":
                other[at] = r.choice(letters)
        lines += [line, "".join(other)]
    rows = list(enumerate(lines))
    near = set()
    for (a, x), (b, y) in combinations(rows, 2):
        most = int(0.1 * max(len(x), len(y)) + 1e-9)
        if abs(len(x) - len(y)) <= most and linededup.edit_distance(x, y, most) <= most:
            near.add((a, b))
    gone = {x.doc_id for x in linededup.duplicate_lines(frame(spark, rows)).collect()}
    pairs, found = len(near), sum(b in gone for _, b in near)
    assert pairs >= 95 and found >= 0.97 * pairs and gone <= {b for _, b in near}


def edited(r, line, kind, share):
    """A line with a share of its letters replaced, inserted or deleted, or as many spaces taken away or put into words."""
    out = list(line)
    for at in sorted(r.sample(range(1, len(line) - 1), int(share * len(line))), reverse=True):
        if kind == "inserted":
            out.insert(at, r.choice("etaoinshrdlu"))
        elif kind == "deleted":
            del out[at]
        elif kind == "replaced":
            out[at] = r.choice("etaoinshrdlu")
        else:
            out[at] = "" if out[at] == " " else out[at] + " "
    return " ".join("".join(out).split())


@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted", "spaces"])
def test_lines_share_a_key_after_each_kind_of_edit(kind):
    """Of pairs that brute force finds similar, with six edits scattered over each hundred characters."""
    r, met, pairs = random.Random(7), 0, 0
    word = lambda: "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(2, 8)))
    for words in (6, 10, 15, 20, 30, 60, 150):
        lines = [" ".join(word() for _ in range(words)) for _ in range(60)]
        both = [(x, y) for x in lines if linededup.similar(x, y := edited(r, x, kind, 0.06))]
        keys = [linededup.sketches([x.encode() for x in side])[1] for side in zip(*both, strict=True)]
        pairs += len(both)
        met += sum(bool(set(a[a != 0].tolist()) & set(b[b != 0].tolist())) for a, b in zip(*keys, strict=True))
    assert pairs > 300 and met >= 0.93 * pairs


def test_lines_with_a_shared_stretch_at_another_place_are_no_candidates(spark):
    """Unrelated lines that share one long passage, each at another place, are not compared, however many they are."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(2, 8)))
    passage = [word() for _ in range(24)]
    lines = []
    for i in range(60):
        own = [word() for _ in range(60)]
        lines.append(" ".join([*own[: i], *passage, *own[i:]])[:400])
    assert not any(linededup.similar(x, y) for x, y in combinations(lines, 2))
    found = linededup.candidates(frame(spark, list(enumerate(lines))))
    pairs = linededup.remaining_pairs(found, spark.createDataFrame([], "a long, b long")).count() + linededup.leading_pairs(found).count()
    assert pairs < 60 * 59 / 2 * 0.4


def test_groups_of_unlike_lines_list_no_pairs(spark):
    """Lines that share a passage at one place give rows that grow with the lines; links among them are found all the same."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(4, 6)))
    passage, lines = [word() for _ in range(40)], []
    for _ in range(30):
        line = [*passage, *(word() for _ in range(30))]
        lines += [" ".join(line)[:380], " ".join([*line[:40], word(), *line[41:]])[:380]]
    lines = list(dict.fromkeys(x.strip() for x in lines))
    near = [(x, y) for x, y in combinations(range(len(lines)), 2) if linededup.similar(lines[x], lines[y])]
    docs = frame(spark, list(enumerate(lines)))
    found = linededup.candidates(docs)
    assert found.where("key IS NULL").select("a", "b").distinct().count() < len(lines) * (len(lines) - 1) / 2 * 0.4
    ids = [int(np.uint64(linededup.xxhash.xxh3_64_intdigest(x.encode())).astype(np.int64)) for x in lines]
    payloads = spark.createDataFrame([(i, x.encode()) for i, x in zip(ids, lines, strict=True)], "id long, payload binary")
    edges = linededup.pair_edges(linededup.leading_pairs(found), payloads, "links")
    more = linededup.remaining_pairs(found, edges, payloads)
    links = edges.unionByName(more)
    assert {tuple(sorted((ids.index(x.a), ids.index(x.b)))) for x in links.collect()} <= set(near)
    group = {x.id: x.component for x in graph.components(links).collect()}
    assert len(near) >= 20 and all(group[ids[x]] == group[ids[y]] for x, y in near)


def test_lines_that_share_many_keys_are_compared_once(monkeypatch):
    """In the first of their groups, in order of keys, that a pair fits; in one window of length, if they share both."""
    texts = [prose(1, 30), edit(prose(1, 30), 3), prose(2, 30)]
    keys = [(k << 7) + k for k in range(1, 6)]
    asked, near = [], linededup.near
    monkeypatch.setattr(linededup, "near", lambda x, y: asked.extend(zip(x, y, strict=True)) or near(x, y))
    monkeypatch.setattr(linededup, "distances", lambda chars, bins, left, right: np.zeros(len(left)))
    rows = []
    for line, text in enumerate(texts):
        places = [{"key": k, "place": 100 * line if k == keys[0] else linededup.ANYWHERE, "marks": 0} for k in keys]
        for i, k in enumerate(keys):
            for window in (8, 9) if k == keys[1] else (0,):
                rows.append({"key": k, "window": window, "even": 8, "place": places[i]["place"], "marks": 0, "x": 0, "y": 0, "own": 0, "line": line, "chars": 200, "label": line, "payload": text.encode(), "earlier": places[:i]})
    schema = pa.schema([(c, pa.int64()) for c in ("key", "window", "even", "place", "marks", "x", "y", "own", "line", "chars", "label")] + [("payload", pa.binary()), ("earlier", pa.list_(pa.struct([(c, pa.int64()) for c in ("key", "place", "marks")])))])
    assert linededup.meet(pa.Table.from_pylist(rows, schema), False).num_rows == 3
    links = linededup.meet(pa.Table.from_pylist(rows, schema), True).to_pylist()
    assert links == [{"a": 0, "b": 1}] and len(asked) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc版", min_size=1, max_size=150), st.integers(0, 20), st.randoms(use_true_random=False)), min_size=1, max_size=12))
def test_edit_distances_of_many_pairs(cases):
    left, right = [x for x, _, _ in cases], []
    for x, edits, r in cases:
        y = list(x)
        for _ in range(edits):
            at = r.randrange(len(y))
            y[at : at + r.randrange(2)] = r.choice(["", "a", "bc"])
            y = y or ["a"]
        right.append("".join(y))
    most = np.array([max(len(x), len(y)) // 10 for x, y in zip(left, right, strict=True)])
    want = [levenshtein(x, y) <= k for x, y, k in zip(left, right, most.tolist(), strict=True)]
    assert linededup.side_by_side(left, right, most).tolist() == want and linededup.near(left, right).tolist() == want


def test_words_with_equal_first_letters_only_are_no_candidates(spark):
    """Unrelated lines whose words begin alike are not listed as candidates, near copies of one of them are."""
    r = random.Random(6)
    heads = [r.choice("abcdefghijklmnop") for _ in range(40)]
    word = lambda c: c + "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(4))
    lines = [" ".join(map(word, heads)) for _ in range(30)]
    docs = frame(spark, list(enumerate(lines)))
    found = linededup.candidates(docs)
    none = spark.createDataFrame([], "a long, b long")
    assert linededup.leading_pairs(found).count() + linededup.remaining_pairs(found, none).count() < 30 * 29 / 2 * 0.05
    near = [*lines, lines[0].replace(lines[0][30], "x", 2)]
    assert {x.doc_id for x in linededup.duplicate_lines(frame(spark, list(enumerate(near)))).collect()} == {30}


def test_similar_lengths_share_a_window(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(11, 400), *range(1000, 1250)]], "chars int")
    here = {}
    for x in rows.select("chars", linededup.windows()).collect():
        here.setdefault(x.chars, set()).add(x.window)
    assert all(here[a] & here[b] for a in here for b in here if a <= b and (b - a) * 10 <= b)
    assert not here[11] & here[300]


def test_short_lines(spark):
    """Short boilerplate, long lines without spaces and scripts without spaces count; very short fragments stay."""
    url = "https://example.org/" + "a/long/path/" * 9
    rows = [(1, "All rights reserved.\nMenu\n" + url), (2, "ALL RIGHTS RESERVED\nMenu\n" + url + "x"), (3, "版权所有\nTerms of use\nMenu"), (4, "版权所有\nterms of use\nTerms of uses")]
    gone = {x.doc_id: x.lines for x in linededup.duplicate_lines(frame(spark, rows)).collect()}
    assert gone == {2: [0, 2], 4: [0, 1]}


def test_long_lines_of_few_words_share_no_key():
    """Unrelated addresses and lines in a script without spaces meet nobody; copies with a few edits still meet."""
    r = random.Random(12)
    urls = [("https www.example.org " + "".join(r.choice("abcdefghijklmnop/0123456789") for _ in range(r.randint(120, 140)))).encode() for _ in range(200)]
    han = [("版权" + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randint(118, 150)))).encode() for _ in range(200)]
    for lines in (urls, han):
        _, keys = linededup.sketches(lines)
        times = Counter(int(k) for row in keys for k in set(row[row != 0].ravel().tolist()))
        assert max(times.values()) <= 12
    near = [urls[0][:60] + b"x" + urls[0][61:100] + b"yy" + urls[0][102:], han[0].decode().replace(han[0].decode()[70], "").encode()]
    for line, other in zip((urls[0], han[0]), near, strict=True):
        _, keys = linededup.sketches([line, other])
        assert set(keys[0].ravel().tolist()) & set(keys[1].ravel().tolist()) - {0}


def toxic_corpus(n=600):
    r, bad = random.Random(6), ["blockhead", "scoundrel"]
    rows, labels = [], []
    for i in range(n):
        words, y = prose(5000 + i, 60).split(), int(i % 4 == 0)
        if y:
            words.insert(r.randrange(60), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity(spark, none):
    rows, labels = toxic_corpus()
    extra = [(1000, "so then b-l-o-c-k-h-e-a-d it is"), (1001, "a b l o c k h e a d here"), (1002, None), (1003, ""), (None, "alpha beta"), (1004, "blo*ckh*ead"), (1005, "the blockxhead"), (1006, "a scounddrel")]
    got = toxicity.toxicity(frame(spark, rows + extra), spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")).collect()
    truth = {d: y for d, _, y in labels}
    wrong = [g.doc_id for g in got if g.doc_id in truth and g.predicted != truth[g.doc_id]]
    assert len(wrong) <= 3
    more = {g.doc_id: g.predicted for g in got if g.doc_id not in truth}
    assert more[1000] == more[1001] == more[1004] == more[1005] == more[1006] == 1 and more[1002] == more[1003] == more[None] == 0
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(none, nothing).count() == 0
    assert {g.predicted for g in toxicity.toxicity(frame(spark, extra), nothing).collect()} == {0}


@pytest.mark.parametrize("dense", [96, 0])
def test_subsequence_weights_equal_the_kernel(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE_LETTERS", dense)
    m = toxicity.Model(["^idiot", "^clown", "^the"], np.array([1.0, 0.5, -1.0]), -0.3)
    words = ["^idiot", "^id-iot", "^xyz", "^ab", "^idiotic" * 3]
    assert m.word_margins(words) == pytest.approx(m.features(words) @ m.weights + m.bias, abs=1e-5)


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_corpus()
    clean = [(d, t) for d, t in rows if d % 4]
    rows += [(2000, clean[0][1] + " tail"), (2001, prose(7777, 200)), (2002, edit(prose(7777, 200), 50)), (2003, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"o{i}"))
        docs = spark.read.parquet(str(tmp_path / f"o{i}"))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert i == 3 or docs.columns == names
    kept_clean = {d for d, _ in clean} & seen[0]
    assert len(kept_clean) >= len(clean) - 3 and len(seen[0] & {d for d, _, y in labels if y}) <= 3
    assert seen[1] == seen[0] and {2001, 2003} <= seen[2] and 2002 not in seen[2] and seen[3] == seen[2]
    whole = corpus_pipeline.run(spark, str(tmp_path))  # the cuts may lie elsewhere, the documents' ids are the same
    assert Counter(map(tuple, whole.groupBy("doc_id").agg(F.sum("length")).collect())) == Counter(map(tuple, docs.groupBy("doc_id").agg(F.sum("length")).collect()))
