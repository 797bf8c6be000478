"""Whitening, Merkle manifests and SentencePiece codes against plain re-statements."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from failsig.llm import merkle, pieces, queries, whiten

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, row int"


def stored(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# -- whitening --------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    return x, c, e[::-1], u[:, ::-1]


def check_whitening(df, vectors, ids):
    x, c, e, _ = plain_whitening(vectors)
    n, count = len(x), df.component.max()
    w = np.zeros((n, count))
    for r in df.itertuples():
        w[ids.index(r.vec_id), r.component - 1] = r.whitened
    assert set(df.n) == {n} and df.identity_error.nunique() == 1
    assert df.identity_error.iloc[0] < 1e-9
    assert np.abs(w.T @ w / n - np.eye(count)).max() < 1e-9
    # the axes, read off the coordinates, are unit eigenvectors
    axes = c.T @ w / n / np.sqrt(e[:count])
    v = c.T @ c / n
    assert np.abs(v @ axes - axes * e[:count]).max() < 1e-9 * e[0]
    assert np.abs((axes**2).sum(0) - 1).max() < 1e-9
    shares = df.groupby("component").explained.first().to_numpy()
    assert np.abs(shares / (e[:count] / e.sum()) - 1).max() < 1e-9
    exact = [
        sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.astype(int).sum(0), strict=True)) for row in x
    ]
    assert all(exact[ids.index(r.vec_id)] == r.deviation for r in df.itertuples())


VECTORS = "vec_id long, embedding array<float>, label int, whitened int, n string"


def whitening_of(spark, path, rows):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    return queries.op11_whitening(spark, stored(df.repartition(5), path, "embeddings")).toPandas()


def test_whitening_of_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = queries.op11_whitening(spark, sf).toPandas()
    assert len(got) == 32 * len(given)
    check_whitening(got, np.stack(given.embedding), given.vec_id.tolist())


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(i, [float(a) for a in rng.normal(size=6)]) for i in range(40)]
    odd = [
        (100, None),
        (101, []),
        (102, [1.0, None, 2.0, 3.0, 4.0, 5.0]),
        (103, [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0]),
        (104, [float("inf")] + [0.0] * 5),
        (105, [1.0, 2.0]),
    ]
    again = [(200 + i, good[0][1]) for i in range(30)]
    rows = good + again
    got = whitening_of(spark, tmp_path, rows + odd)
    assert sorted(set(got.vec_id)) == [i for i, _ in rows]
    check_whitening(got, [v for _, v in rows], [i for i, _ in rows])


def test_whitening_with_equal_eigenvalues(spark, tmp_path):
    """The corners of a cube: one space of equal variance, and a direction of its own."""
    rows = [
        [float(s) * 3 for s in (2 * ((i >> k) & 1) - 1 for k in range(5))] + [float(i % 2) * 0.0]
        for i in range(32)
    ]
    got = whitening_of(spark, tmp_path, list(enumerate(rows)))
    assert got.component.max() == 5  # the constant entry has no variance
    check_whitening(got, rows, list(range(32)))


def test_whitening_of_fewer_rows_than_dimensions(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [[float(a) for a in rng.normal(size=20)] for _ in range(4)]
    got = whitening_of(spark, tmp_path, list(enumerate(rows)))
    assert got.component.max() == 3
    check_whitening(got, rows, list(range(4)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 3])
def test_whitening_of_nothing(spark, tmp_path, rows):
    assert len(whitening_of(spark, tmp_path, rows)) == 0


def test_deviation_beyond_doubles():
    x = np.array([[1 << 31, -(1 << 31)], [5, 7]], np.int64)
    n = 1 << 30
    c = whiten._centred(x, n, np.array([3, 4], np.int64))
    assert c.tolist() == [[(1 << 61) - 3, -(1 << 61) - 4], [5 * n - 3, 7 * n - 4]]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_qd_and_twisted_vectors(d):
    rng = np.random.default_rng(d)
    r = np.triu(rng.normal(size=(d, d))) * 10.0 ** rng.integers(-4, 4, size=(1, d))
    e, z = whiten.directions(r, d)
    s = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(e[: z.shape[1]]), s[: z.shape[1]], rtol=1e-10)
    assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-9
    assert np.abs(r.T @ (r @ z) - z * e[: z.shape[1]]).max() < 1e-12 * e[0] * d


# -- Merkle manifest --------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def runs(levels, i):
    for level in levels[:-1]:
        yield level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        i //= 3


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below.append(tree([leaf(r) for r in groups[s]]))
    top = tree([levels[-1][0] for levels in below])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = [*runs(below[j], i), *runs(top, j)]
            proof = [n for run, at in path for k, n in enumerate(run) if k != at]
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = (*r[:4], r[4].replace("\n", ""))
            end = leaf(seen)
            for run, at in path:
                end = digest(*run[:at], end, *run[at + 1 :])
            root = top[-1][0]
            out.append((r[0], leaf(r), below[j][-1][0], root, digest(*proof), end, end == root))
    return out


def manifest_rows(n):
    rng = random.Random(n)
    rows = [
        (i, rng.choice(["hot", "hot", "é", "z"]), "en", i, f"text {i}\nline" if i % 3 else f"text {i}")
        for i in range(n)
    ]
    rows += [(1000 + i, f"s{i}", None, None, "x\n" * i) for i in range(7)]
    rows += [
        (5, "hot", "en", 5, "text 5\nline"),
        (5, "hot", "en", 5, "text 5\nline"),
        (None, "hot", None, 1, "a\nb"),
        (None, "hot", None, 1, None),
        (None, None, None, None, None),
        (7, None, "en", 0, ""),
        (8, "", "en", 0, "empty source"),
        (2000, "long", "en", 3, "long\n" * 300_000),
    ]
    return rows


def manifest_of(spark, path, rows):
    df = spark.createDataFrame([(d, t, g, s, n, "clash", 1) for d, s, g, n, t in rows], DOCS)
    return queries.op12_merkle(spark, stored(df.repartition(3), path, "documents"))


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("block", "joined"), [(1024, 256), (4, 2), (7, 3)])
def test_manifest(spark, tmp_path, monkeypatch, block, joined):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "JOINED", joined)
    rows = manifest_rows(60)
    got = [tuple(r) for r in manifest_of(spark, tmp_path, rows).collect()]
    assert key(got) == key(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_small_manifests(spark, tmp_path, n):
    rows = [(i, "a", "en", 1, "t\n") for i in range(n)]
    got = [tuple(r) for r in manifest_of(spark, tmp_path, rows).collect()]
    assert key(got) == key(plain_manifest(rows) if rows else [])


def test_proofs_as_lists(spark):
    df = spark.createDataFrame([(i, "t", "en", f"s{i % 5}", 1, "", 0) for i in range(40)], DOCS)
    rows = merkle.proved(df, siblings=True).collect()
    assert all(r.verified and digest(*r.proof) == r.proof_sha256 for r in rows)


@pytest.mark.parametrize(("size", "lo", "hi"), [(1, 0, 1), (10, 3, 5), (100, 31, 64), (100, 0, 100)])
def test_missing_nodes_are_the_least(size, lo, hi):
    """No named node can be made from the leaves and the other named ones."""
    missing = set(merkle._missing(size, lo, hi))
    sizes = merkle._sizes(size)
    path = {(k, i) for k in range(len(sizes)) for i in range(lo // 3**k, (hi - 1) // 3**k + 1)}
    beside = {
        (k, i)
        for k, j in path
        if k < len(sizes) - 1
        for i in range(j // 3 * 3, min(j // 3 * 3 + 3, sizes[k]))
    }
    assert missing == beside - path


# -- SentencePiece ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.vocabulary(MODEL))


def odd_texts(vocabulary, n):
    rng = random.Random(11)
    marks = ["▁", "  ", "a", "<s>", "</s>", "<0x41>", "\x00", "é", "é", "0", "12", "=", "=====", "\n"]
    for k in range(n):
        m = rng.randrange(50)
        yield [
            lambda: "".join(rng.choice("ab \n\t") for _ in range(m)),
            lambda: " " * m + "x" + " " * rng.randrange(40),
            lambda: "".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(m)),
            lambda: "".join(rng.choice(vocabulary.pieces) for _ in range(m // 3)),
            lambda: "".join(rng.choice(vocabulary.pieces).replace("▁", " ") for _ in range(m // 3)),
            lambda: "".join(rng.choice("aeinrst") for _ in range(m * 4)),
            lambda: "".join(rng.choice(marks) for _ in range(m)),
        ][k % 7]()


def test_codec_equals_the_library(library, codec):
    for text in odd_texts(pieces.vocabulary(MODEL), 3000):
        want = library.encode(text, add_bos=True, add_eos=True)
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want, repr(text)
        assert codec.decode(packed) == library.decode(want), repr(text)


def test_decoding_of_any_ids(library, codec):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(260), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_every_prefix_has_one_last_token(library, codec):
    """What the method rests on: exactly one piece that ends a prefix can stand there."""
    word = "▁counterrevolutionaries"
    for end in range(2, len(word) + 1):
        tokens = codec.tokens(word[:end])
        fitting = [
            word[start:end]
            for start in range(end)
            if word[start:end] in codec.ids
            and codec.fits(([""] + codec.tokens(word[:start]))[-1] if start else "", word[start:end])
        ]
        assert fitting == [tokens[-1]]


def test_codes_of_rows(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 50)
    texts = [None, "", " ", "a", "<s> </s>", "💡 \x00", "same text", "same text", "ab" * 200_000, " " * 100_000]
    texts += list(odd_texts(pieces.vocabulary(MODEL), 50))
    rows = [(i if i % 9 else None, t, "en", "s", 0, "clash", 1) for i, t in enumerate(texts)]
    sf = stored(spark.createDataFrame(rows, DOCS).repartition(3), tmp_path, "documents")
    got = [tuple(r) for r in queries.op13_pieces(spark, sf).collect()]
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        text = library.decode(ids).encode()
        want.append((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert key(got) == key(want)


def test_codes_of_given_rows(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    got = queries.op13_pieces(spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    ids = [library.encode(t or "", add_bos=True, add_eos=True) for t in docs.text]
    want = pd.DataFrame(
        {
            "doc_id": docs.doc_id,
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(library.decode(i).encode()).hexdigest() for i in ids],
        }
    ).sort_values("doc_id", ignore_index=True)
    assert got.equals(want)


def test_codes_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert pieces.encoded(none, MODEL).select("row.*", F.col("ids").alias("codes")).count() == 0


def test_models_that_need_more_are_refused(monkeypatch):
    class Normalising(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Normalising)
    with pytest.raises(ValueError, match="normalises"):
        pieces.vocabulary(MODEL)
