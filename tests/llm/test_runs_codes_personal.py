"""Periodic runs, vector codes and personal data against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tesserine.llm import periodic_runs as runs
from tesserine.llm import personal_data as personal
from tesserine.llm import queries
from tesserine.llm import vector_codes as codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def block(texts):
    numbered = [runs.number_words(" ".join(map(str, w)).encode()) for w in texts]
    first = np.concatenate([[0], np.cumsum([len(a) for a, _ in numbered])])
    shift = np.concatenate([[0], np.cumsum([len(b) for _, b in numbered])])
    return np.concatenate([a.astype(np.int64) + shift[i] for i, (a, _) in enumerate(numbered)]), first


def periodic_words(r):
    n, kinds = r.choice([0, 1, 11, 12, 13, 24, 25, 90, r.randint(0, 260)]), r.choice([1, 2, 3, 12, 150])
    w = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 10 else 0):
        a, p, e = r.randrange(n), r.randint(1, max(1, n // 3)), r.randint(0, n)
        for i in range(a + p, e):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least", [12, 7, 2])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(250):
        texts = [periodic_words(r) for _ in range(r.randint(1, 5))]
        assert runs.find_runs(*block(texts), least) == [brute_runs(w, least) for w in texts]


def test_transforms_and_pairs_count_the_same(monkeypatch):
    r = random.Random(8)
    texts = [[r.randrange(3) for _ in range(400)] + [r.randrange(2000) for _ in range(200)] * 3 for _ in range(3)]
    expected = runs.find_runs(*block(texts))
    assert expected == [brute_runs(w) for w in texts]
    for name in ("_pairs", "_transform"):
        used = []
        own = getattr(runs.Lags, name)
        monkeypatch.setattr(runs.Lags, name, lambda self, *a, own=own, used=used: (used.append(1), own(self, *a))[1])
        assert runs.find_runs(*block(texts)) == expected and used
    # Whatever is counted by transforms alone, nothing changes.
    words, first = block(texts)
    live = np.arange(len(words))
    one, two = runs.Lags(words, first), runs.Lags(words, first)
    one.add(live, 1, 12)
    text = np.searchsorted(first, live, "right") - 1
    for t in range(len(texts)):
        mine = live[text == t]
        two._transform(t, [mine[words[mine] == w] for w in np.unique(words[mine])], 1, 12)
    assert (one.counts == two.counts).all()


def test_runs_of_long_texts():
    w = np.arange(60_000) % 7919
    assert runs.find_runs(*block([w.tolist(), [1] * 30_000])) == [[(0, 60_000, 7919)], [(0, 30_000, 1)]]


def test_numbers_of_words_across_pieces(monkeypatch):
    monkeypatch.setattr(runs, "SPLIT_BYTES", 7)
    raw = "é\x0b\x1ca  b\tlonger-than-a-piece\r\nb a".encode()
    numbers, names = runs.number_words(raw)
    assert [names[k].decode() for k in numbers] == WORD.findall(raw.decode())


def texts_with_runs():
    r = random.Random(4)
    some = [" ".join(f"w{x}" for x in periodic_words(r)) for _ in range(60)]
    long = " ".join(f"v{r.randrange(4000)}" for _ in range(70_000))
    return [None, "", " \n\t ", "one", "x " * 40, *some, some[0], some[0], "a b\x0b" * 30, long + " " + "é ü " * 300]


def test_periodic_runs(spark):
    texts = texts_with_runs()
    rows = spark.createDataFrame([(i, t, "other", -1) for i, t in enumerate(texts)], "doc_id long, text string, Collapsed string, runs int").repartition(3)
    got = {r["doc_id"]: r for r in runs.periodic_runs(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        expected = brute_runs(w) if len(w) < 5000 else [(70_000, 600, 2)]
        kept = [True] * len(w)
        for s, n, q in expected:
            kept[s + q : s + n] = [False] * (n - q)
        assert [tuple(x) for x in got[i]["runs"]] == expected and got[i]["n_words"] == len(w)
        assert got[i]["collapsed"] == (None if t is None else " ".join(x for x, k in zip(w, kept, strict=True) if k))
    assert runs.periodic_runs(rows.limit(0)).count() == 0


def test_query_of_runs(spark, tmp_path):
    texts = texts_with_runs()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w) if n < 5000 else runs.find_runs(*block([w]))[0]
        kept = [True] * n
        for s, m, q in found:
            kept[s + q : s + m] = [False] * (m - q)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        expected.append((str(i), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for x, k in zip(w, kept, strict=True) if k))))
    got = [(str(r["doc_id"]), *r[1:]) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


# ---------------------------------------------------------------- vector codes


def brute_codes(vectors, parts=4, entries=256, rounds=4):
    """By full searches in Python integers; ``vectors`` are (id, integers) in the order of starting."""
    cut = [[u[p * len(u) // parts : (p + 1) * len(u) // parts] for p in range(parts)] for _, u in vectors]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], book), []).append(v[p])
            for e, some in groups.items():
                book[e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    code = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return code, [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, code, strict=True)], books


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, units string, code string").repartition(3)


@pytest.mark.parametrize("entries", [256, 9])
def test_codes_equal_brute_force(spark, entries):
    r = random.Random(entries)
    some = [[r.choice([-2.0, -1.0, -0.5, 0.0, 0.25, 1.5]) if k % 2 else r.gauss(0, 1) for k in range(8)] for _ in range(300)]
    some += some[:40] + [[0.0] * 8] * 90
    rows = [(7 * i % 431, v, i % 3 or None, "x", "y") for i, v in enumerate(some)]
    rows += [(900, None, 1, "x", "y"), (-3, [1.0, None] * 4, 1, "x", "y"), (-2, [float("nan")] * 8, 1, "x", "y"), (-1, [float("-inf")] + [0.0] * 7, 1, "x", "y"), (None, [0.5] * 8, None, "x", "y"), (5, some[5], 2, "x", "y"), (5, some[5], 2, "x", "y")]
    exact = lambda v: [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]
    good = [(i, exact(v)) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    code, error, books = brute_codes(good, entries=entries)
    got, made = codes.vector_codes(vectors(spark, rows), entries=entries)
    assert sorted((str(r["vec_id"]), r["codes"], r["error"]) for r in got.collect()) == sorted((str(i), c, e) for (i, _), c, e in zip(good, code, error, strict=True))
    assert made.entries.tolist() == books


def test_query_of_codes_and_label_errors(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(64)], [None, 1, 2][i % 3]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.sql(queries.SQL["op12_vector_codes"]).df().sort_values("vec_id").reset_index(drop=True)
    got = queries.op12_vector_codes(spark, str(tmp_path)).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert got.equals(expected[got.columns])


def test_bounds_spare_searches_and_hold():
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, (12, 6))
    units = middle[rng.integers(0, 12, 2000)] + rng.integers(-60, 60, (2000, 6))
    entries = middle + rng.integers(-300, 300, (12, 6))
    code, upper, lower = codes.search(units, entries)
    searched = 0
    for _ in range(6):
        after = entries.copy()
        for e in range(12):
            if (code == e).any():
                after[e] = units[code == e].sum(axis=0) // (code == e).sum()
        way = np.sqrt(((after - entries) ** 2).sum(axis=1)) * (1 + 1e-15)
        searched += codes.reassign(units, after, way, code, upper, lower)
        entries = after
        far = ((units[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all()
        own = np.sqrt(far[np.arange(2000), code])
        far[np.arange(2000), code] = 1 << 40
        assert (upper >= own).all() and (lower <= np.sqrt(far.min(axis=1))).all()
    assert searched < 2000


def test_large_components_are_exact():
    units = np.array([[1 << 28, 1], [-(1 << 28), 0]], np.int64)
    assert codes.distances(units, units).tolist() == [[0, (1 << 58) + 1], [(1 << 58) + 1, 0]]
    assert codes.own_distances(units, units, np.array([1, 0])).tolist() == [(1 << 58) + 1] * 2


def test_codes_of_odd_tables(spark):
    none = vectors(spark, [(1, None, 1, "x", "y")])
    assert codes.vector_codes(none)[0].count() == 0 and codes.vector_codes(none.limit(0))[0].count() == 0
    one = codes.vector_codes(vectors(spark, [(1, [0.5, 1.0, -0.3, 0.0], None, "x", "y")]))[0].first()
    assert (one["codes"], one["error"], one["label"]) == ([0] * 4, 0, None)
    for bad in ([(1, [0.5] * 4, 1, "x", "y"), (2, [0.5] * 8, 1, "x", "y")], [(1, [0.5] * 3, 1, "x", "y")], [(1, [1e30] * 4, 1, "x", "y")]):
        with pytest.raises(ValueError, match="one length"):
            codes.vector_codes(vectors(spark, bad))


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit_right(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and check_digit_right(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def odd_texts():
    r = random.Random(6)
    good = ["4111 1111 1111 1111", "4111-1111-1111-1111", "x.y@z.com", "+1 (222) 333-4444", "192.168.1.1", "10.0.0.256", "001.2.3.04", "a@b.c@d.e"]
    out = []
    for alphabet in ("0123456789 -", "0123456789.", "01.@a-", "+01 ().-", "a@b.c-d%_ é", "4 1-", "0123456789 -.+@aé日"):
        for _ in range(400):
            noise = lambda n: "".join(r.choice(alphabet) for _ in range(r.randint(0, n)))  # noqa: E731, B023
            out.append(noise(40) + (r.choice(good) if r.random() < 0.4 else "") + noise(20))
    return out


def test_base_spans_equal_the_patterns():
    for t in odd_texts():
        assert [(personal.KINDS[k], s, e) for k, s, e in personal.code_point_spans(t.encode()) if personal.KINDS[k] in personal.BASE] == brute_spans(t), t


def test_anchors_at_the_border_of_pieces(monkeypatch):
    text = "aé 4111 1111 1111 1111, é x.y@z.com +1 (222) 333-4444 1.2.3.4 password: abc123def http://u:p@h.org/x "
    expected = personal.code_point_spans(text.encode())
    assert len(expected) == 7
    for size in range(1, 60):
        monkeypatch.setattr(personal, "SEARCH_BYTES", size)
        assert personal.code_point_spans(text.encode()) == expected


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 AND", ["DE89 3704 0044 0532 0130 00"]),
        ("iban DE89370400440532013001", []),
        ("see IBAN GB82WEST12345698765432.", ["GB82WEST12345698765432"]),
        ('token = "0641917ea4e9feb9" x', ["0641917ea4e9feb9"]),
        ("db_password=eb5cd12f. Next", ["eb5cd12f"]),
        ("account no. 12345678, compaccount: 12345678", ["12345678"]),
        ("tokens: 1234567 token 1234567 token: words", []),
        ("password: short1", ["short1"]),
        ("password: a1", []),
        ("mailto:sip@x.org, tel:+4912345678. hotel:12345678", ["mailto:sip@x.org", "tel:+4912345678"]),
        ("http://joe:pw@host.com/a?b, http://host.com/a@b http://http://@x", ["http://joe:pw@host.com/a?b"]),
        ("Licensed under the Apache License, Version 2.0.", []),
    ],
)
def test_spans_of_schemes_and_cues(text, found):
    assert [text[s:e] for k, s, e in personal.code_point_spans(text.encode()) if personal.KINDS[k] not in personal.BASE] == found


def test_dense_anchors_take_linear_time():
    import time

    for piece in ("a@", "1.", "1 ", "+1", "http://", "tel:", "token=", "password: 1", "1.2.3.", "@a.", "iban DE12"):
        took = []
        for n in (20_000, 160_000):
            began = time.perf_counter()
            personal.byte_spans((piece * n).encode())
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * took[0] + 1, piece


def test_personal_data(spark):
    texts = [None, "", "plain words", "é x.y@z.com", "é x.y@z.com", *odd_texts()[:300:3], "w " * 200_000 + "x.y@z.com" + " w" * 100_000 + " password: abc123"]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, Spans string").repartition(3)
    found = personal.find_personal_data(rows)
    assert found.columns == ["doc_id", "text", "spans"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in personal.BASE] == brute_spans(t or "")
    assert personal.find_personal_data(rows.limit(0)).count() == 0
    shown = {r["doc_id"]: r["text"] for r in personal.redact(found).collect()}
    assert (shown[0], shown[1], shown[2], shown[3]) == (None, "", "plain words", "é <EMAIL>")
    assert shown[len(texts) - 1] == "w " * 200_000 + "<EMAIL>" + " w" * 100_000 + " password: <ACCOUNT>"


def test_query_of_personal_data(spark, tmp_path):
    texts = [None, "", *odd_texts()[::5], "token: 123456 x.y@z.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_personal_data(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        assert [got[i][f"n_{k}"] for k in personal.BASE] == [sum(s[0] == k for s in base) for k in personal.BASE]
        assert got[i]["base_sha256"] == sha(",".join(":".join(map(str, s)) for s in base))
    assert got[len(texts) - 1]["spans"] == "email:14:23,account:7:13"
