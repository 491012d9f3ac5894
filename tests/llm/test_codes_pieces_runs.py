"""Vector codes, piece spans and word runs against brute force and the library."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from nitrogrid.llm import piece_spans, vector_codes, word_runs
from nitrogrid.llm.common import documents
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 vector codes

def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    whole = [[int(Fraction(x) * 256 // 1) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    n = width // parts
    cut = [[w[p * n:(p + 1) * n] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = near()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    most = (1 << 63) - 1
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), min(most, d), min(most, by_label[label]), digest)
                   for (i, _, label), f, d in zip(kept, found, errors)), key=repr)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, entry int"
    return spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], schema).repartition(3)


def as_floats(rows):
    """Values as a float column holds them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def vector_rows(kind):
    rng = random.Random(5)
    size = {"plain": 32, "three": 48, "ragged": 40, "huge": 32, "few": 16}[kind]
    rows = [(i, [rng.choice([rng.uniform(-3, 3), rng.randint(-2, 2)]) for _ in range(size)], rng.choice([None, 1, 2]))
            for i in range(5 if kind == "few" else 150)]
    rows += [(200, None, 1), (201, [None] * size, 1), (202, [float("nan")] * size, 2), (203, [float("inf")] + [0.0] * (size - 1), 2)]
    rows += [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, rows[4][1], None)] + [(300 + k, rows[0][1], 1) for k in range(40)]
    if kind == "ragged":
        rows += [(400 + k, [1.5] * k, 3) for k in range(60)]
    if kind == "huge":
        rows += [(k - 20, [rng.choice([1e30, -3e38, 2.0 ** 70, 1e-30, 5e8]) for _ in range(size)], 3) for k in range(9)]
    return as_floats(rows)


@pytest.mark.parametrize("kind", ["plain", "three", "ragged", "huge", "few"])
def test_vector_codes(spark, kind):
    rows = vector_rows(kind)
    got = vector_codes.vector_codes(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)


def test_vector_codes_of_nothing(spark):
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 16, 33])
def test_transform_multiplies_distances_by_its_size(length):
    x = np.random.default_rng(length).integers(-9, 10, (20, length))
    t = vector_codes.transformed(x)
    size = t.shape[1]
    assert ((t[:10] - t[10:]) ** 2).sum(axis=1).tolist() == (size * ((x[:10] - x[10:]) ** 2).sum(axis=1)).tolist()
    rows = vector_codes.transformed(np.eye(size, dtype=np.int64))
    changes = [(np.diff(rows[:, k]) != 0).sum() for k in range(size)]
    assert changes == list(range(size))


def test_sums_travel_as_limbs():
    for total in [0, 1, -1, 2 ** 32, -2 ** 32, 10 ** 40, -10 ** 40, 2 ** 31, -5 * 2 ** 64 - 3]:
        found = vector_codes.limbs(total)
        assert sum(v << (32 * i) for i, v in enumerate(found)) == total and all(abs(v) <= 2 ** 32 for v in found)


# 12 pieces

ALPHABET = " \n\t▁abcdeéß中文😀\0​ﬁ①<s></s><unk> the of  "


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def piece_texts():
    rng = random.Random(1)
    found = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*found, "", "<s>", "</s> hi", "<0x0A>", "   ", "▁▁▁", " a  b ", "a" * 3000, "ab" * 5000, " " * 777, "😀" * 99, "x" * 200_000]


def test_pieces_and_spans_as_the_library(library, piece_texts):
    codec = piece_spans.codec(None)
    for text in piece_texts:
        e = codec.encode(text)
        proto = library.encode(text, return_type="proto")
        ids = [p.id for p in proto.pieces]
        begin, end = e.spans()
        assert e.ids().tolist() == ids
        assert list(zip(begin.tolist(), end.tolist())) == [(p.begin, p.end) for p in proto.pieces]
        assert e.decoded().decode() == library.decode(ids)
        # spans lie one behind the other and cover the text
        assert (begin[1:] == end[:-1]).all() and (not ids or (begin[0], end[-1]) == (0, len(text.encode())))


def test_any_ids_decode_as_the_library(library):
    rng = random.Random(2)
    codec = piece_spans.codec(None)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(262) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("options", [{}, {"add_dummy_prefix": True}, {"remove_extra_whitespaces": True, "add_dummy_prefix": True}])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_character_maps(rule, options):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    spec = next(dict(piece_spans.fields(v)) for f, v in piece_spans.fields(theirs.serialized_model_proto()) if f == 3)
    rules = {a.decode(): b.decode() for a, b in piece_spans.compiled_rules(spec.get(2, b"")).items()}
    mine = piece_spans.Normaliser(rules, *(bool(spec.get(k, 1)) for k in (3, 4, 5)))
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(" 　ﬁ①㎏é éＡＢ中ｶﾞ \t\n​ẞß▁ab̀") for _ in range(rng.randint(0, 14)))
        want, origin = theirs.normalize(text, with_offsets=True)
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        got, mapped = mine.normalised(text)
        assert got == want and mapped.tolist()[:len(origin)] == [at[i] for i in origin]


def test_piece_queries(spark, library, odd_rows, piece_texts):
    rows = [*odd_rows, *((1000 + k, t, "en") for k, t in enumerate(piece_texts[-200:]))]
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())))
    got = piece_spans.digests(frame(spark, rows))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)
    whole = piece_spans.encoded(frame(spark, rows)).collect()
    digests = sorted(((r["doc_id"], hashlib.sha256(np.array([r["begins"], r["ends"]], "<i8").T.tobytes()).hexdigest()) for r in whole), key=repr)
    assert digests == sorted(((r["doc_id"], r["spans_sha256"]) for r in got.collect()), key=repr)
    assert sorted(sha(r["decoded"]) for r in whole) == sorted(w[3] for w in want)


def test_no_pieces_of_nothing(nothing):
    assert piece_spans.digests(nothing).count() == 0 and piece_spans.encoded(nothing).count() == 0


# 13 runs

def brute_runs(seq):
    found, n = [], len(seq)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            size = j - i + q
            some = seq[i:i + size]
            if j > i and size >= max(6, 4 * q) and not any(some[d:] == some[:-d] for d in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, seq):
    n = len(seq)
    if doc_id is None or not n:
        return seq
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return seq
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [seq[i] if i < a else seq[a + (i - a) % p] for i in range(n)]


def periodic(rng, alphabet, n):
    seq = [rng.choice(alphabet) for _ in range(rng.randint(0, n))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 9))] * rng.randint(3, 9)
        at = rng.randint(0, len(seq))
        seq[at:at] = unit[:rng.randint(1, len(unit))]
    return seq * rng.randint(1, 5) if rng.random() < 0.2 else seq


def test_runs_of_sequences():
    rng = random.Random(3)
    total = 0
    for _ in range(2500):
        seq = periodic(rng, range(rng.randint(1, 5)), 50)
        want = brute_runs(seq)
        total += len(want)
        assert sorted(word_runs.Runs().runs(seq), key=lambda r: (r[0], r[2])) == want
        batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([" ".join(map(str, seq))])], names=["doc_id", "text"])
        assert [runs for *_, runs in word_runs.batch_runs(batch)] == [want]
    assert total > 2000


def test_long_run():
    assert word_runs.Runs().runs([0] * 30_000) == [(0, 30_000, 1)]
    assert word_runs.Runs().runs([0, 1, 2] * 10_000 + [7]) == [(0, 30_000, 3)]


def brute_run_row(doc_id, text):
    seq = planted_words(doc_id, split_words(text))
    runs = brute_runs(seq)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(seq) if i not in gone)))


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_run_query(spark, odd_rows):
    rng = random.Random(4)
    rows = [*odd_rows, *((2000 + k, " \n".join(periodic(rng, ["a", "b", "é", "the", " "], 120)), "en") for k in range(400))]
    got = word_runs.run_digests(frame(spark, rows))
    want = [brute_run_row(i, t) for i, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 300
    # without the planted periods, with the runs themselves
    for r in word_runs.word_runs(frame(spark, rows[:60])).collect():
        assert all(run["length"] >= max(6, 4 * run["period"]) for run in r["runs"])


def test_runs_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect() if len(r["text"] or "") < 4000]
    some = documents(spark, SF).where("coalesce(length(text), 0) < 4000")
    assert sorted(map(tuple, word_runs.run_digests(some).collect()), key=repr) == sorted((brute_run_row(*r) for r in rows), key=repr)


def test_no_runs_of_nothing(nothing):
    assert word_runs.run_digests(nothing).count() == 0 and word_runs.word_runs(nothing).count() == 0
