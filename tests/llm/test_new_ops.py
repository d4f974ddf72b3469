import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from ferrule.llm import periodic, toxicity, upsert

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLIENTS = "client_id long, _row string, source string, name string, city string, segment string, balance double, _key long"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double, _home string"
PUT = ("source", "segment", "city", "balance")


def crc(x):
    return zlib.crc32(str(x).encode())


def upserted(clients, changes):
    """The contract of op11, file by file."""
    size = 1 + len(clients) // 1000
    rows = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    firsts, best, have = [f[0]["client_id"] for f in files], {}, {c["client_id"] for c in rows}
    after = [list(f) for f in files]
    order = lambda c: tuple((c[k] is not None, c[k]) for k in ("seq", "change_id", "op", *PUT))
    for c in changes:
        k = c["client_id"]
        if k is not None and (k not in best or order(c) > order(best[k])):
            best[k] = c
    for k, c in best.items() if files else []:
        home = max(0, bisect.bisect_right(firsts, k) - 1)
        h = crc(firsts[home]) % 16
        if h > 7:
            continue
        values = {s: c[s] for s in PUT}
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            after = [[x for x in f if x["client_id"] != k] for f in after]
        elif k in have:
            after = [[x | values if x["client_id"] == k else x for x in f] for f in after]
        else:
            after[home].append(dict.fromkeys(clients[0]) | {"client_id": k} | values)
    cut = []
    for f, a in zip(files, after, strict=True):
        a.sort(key=lambda x: x["client_id"])
        if a == f:
            cut.append((f, False))
            continue
        n, at = -(-len(a) // size), 0
        for j in range(n):
            wide = len(a) // n + (j < len(a) % n)
            cut.append((a[at : at + wide], True))
            at += wide
    grown = []
    for f, new in cut:
        if new and grown and grown[-1][1] and len(grown[-1][0]) + len(f) <= size:
            grown[-1] = (grown[-1][0] + f, True)
        else:
            grown.append((f, new))
    cents = lambda x: 0 if x["balance"] is None else math.floor(100 * x["balance"] + 0.5)
    text = lambda x: "|".join(x[s] or "" for s in ("source", "segment", "city"))
    out = [(f[0]["client_id"], len(f), sum(map(cents, f)), sum(zlib.crc32(text(x).encode()) for x in f), hashlib.sha256(",".join(str(x["client_id"]) for x in f).encode()).hexdigest(), new) for f, new in grown]
    return sorted(out)


def shop(seed, n, changes):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "", None, "x" * 3])
    number = lambda: rng.choice([None, -1.005, 0.0, 12.345, 99.995])
    clients = [{"client_id": i if i % 97 else None, "_row": word(), "source": word(), "name": word() if i != 5 else "long " * 50_000, "city": word(), "segment": word(), "balance": number(), "_key": i} for i in range(n)]
    rows = [{"change_id": rng.choice([None, *range(changes)]) if i % 50 == 0 else i, "client_id": rng.choice([None, 7, rng.randrange(-20, n + 60)]), "seq": rng.choice([None, rng.randrange(50)]), "op": rng.choice(["U", "I", "D", None]), "valid_at": None, "source": word(), "segment": word(), "city": word(), "balance": number(), "_home": word()} for i in range(changes)]
    same = [{**c, "seq": 60, "change_id": 1000 + i} for i, c in enumerate(rows[:0])]
    for c in clients[::5]:  # changes that change nothing
        if c["client_id"] is not None:
            same.append({"change_id": 7_000 + c["client_id"], "client_id": c["client_id"], "seq": 99, "op": "U", "valid_at": None, **{k: c[k] for k in PUT}, "_home": None})
    return clients, [*rows, *rows[:30], *same]


@pytest.mark.parametrize("seed,n,changes", [(1, 1700, 900), (2, 300, 4000), (3, 40, 0)])
def test_upsert_against_a_plain_model(spark, tmp_path, seed, n, changes):
    clients, rows = shop(seed, n, changes)
    spark.createDataFrame(clients, CLIENTS).repartition(3).write.parquet(str(tmp_path / "clients.parquet"))
    spark.createDataFrame(rows, CHANGES).repartition(3).write.parquet(str(tmp_path / "client_changes.parquet"))
    got = upsert.query(spark, str(tmp_path)).collect()
    assert sorted((r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got) == upserted(clients, rows)
    assert {r["columns"] for r in got} == {",".join(clients[0])}
    for r in got:
        ids = pq.ParquetFile(r["path"]).read(["client_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and len(ids) == r["n_rows"] and ids[0] == r["first_id"]
    folder = {r["path"].rpartition("/")[0] for r in got}
    assert len(folder) == 1
    import pathlib

    assert {str(p) for p in pathlib.Path(folder.pop()).glob("*.parquet")} == {r["path"] for r in got}


def test_upsert_of_nothing_and_of_all_rows(spark, tmp_path):
    spark.createDataFrame([], CLIENTS).write.parquet(str(tmp_path / "clients.parquet"))
    spark.createDataFrame([], CHANGES).write.parquet(str(tmp_path / "client_changes.parquet"))
    assert upsert.query(spark, str(tmp_path)).count() == 0
    folder = str(tmp_path / "own")
    rows = spark.createDataFrame([(i // 3, "x") for i in range(20)], "k long, v string")
    assert upsert.lay_out(rows, "k", 4, folder) == 5
    table = upsert.Folder(spark, folder, "k", 4)
    deletes = spark.createDataFrame([(i, True, "y") for i in range(7)], "k long, gone boolean, v string")
    table.upsert(table.homes(deletes), "gone", ("v",))
    assert table.written().count() == 0


def test_keys_that_fill_several_files(spark, tmp_path):
    folder = str(tmp_path / "ties")
    rows = [(None, "n"), *[(5, f"a{i}") for i in range(9)], (7, "b"), (9, "c")]
    upsert.lay_out(spark.createDataFrame(rows, "k long, v string"), "k", 3, folder)
    table = upsert.Folder(spark, folder, "k", 3)
    homes = {r["k"]: r["_from"] for r in table.homes(spark.createDataFrame([(5, False, "z"), (6, False, "new"), (-3, True, "q"), (9, False, "c")], "k long, gone boolean, v string")).collect()}
    assert homes[5] == 5 and homes[-3] is None
    table.upsert(table.homes(spark.createDataFrame([(5, False, "z"), (6, False, "new"), (-3, True, "q"), (9, False, "c")], "k long, gone boolean, v string")), "gone", ("v",))
    got = sorted((r["_key"] is not None, r["_key"], r["_row"]["v"]) for r in table.written().collect())
    assert got == [(False, None, "n"), *[(True, 5, "z")] * 9, (True, 6, "new"), (True, 7, "b"), (True, 9, "c")]


def greedy(sizes, size):
    starts, total = [], None
    for i, s in enumerate(sizes):
        if total is None or total + s > size:
            starts.append(i)
            total = 0
        total += s
    return starts


def test_pointer_doubling_marks_what_a_walk_marks(spark):
    from ferrule.llm._work import Workspace

    rng = random.Random(4)
    runs = [[rng.randint(1, 10) for _ in range(rng.randint(1, 60))] for _ in range(7)]
    rows, upto, at, expected = [], 0, 0, set()
    for number, run in enumerate(runs):
        expected |= {at + i for i in greedy(run, 10)}
        for s in run:
            upto += s
            rows.append((at, number, s, upto))
            at += 1
    pieces = spark.createDataFrame(rows, "_at long, _run long, _size long, _upto long")
    first = pieces.groupBy("_run").agg({"_at": "min"}).toDF("_run", "_at").select("_at")
    assert {r["_at"] for r in upsert.reached(first, upsert.next_starts(pieces, 10), Workspace(spark, "t")).collect()} == expected


def runs_by_hand(w, shortest=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                if j + q - i >= max(shortest, times * q):
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, b, q) for (a, b), q in out.items())


def test_runs_against_brute_force():
    rng, total = random.Random(1), 0
    for _ in range(600):
        k = rng.choice([1, 2, 3, 8, 100])
        w = [rng.randrange(k) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 4)):
            p = [rng.randrange(k) for _ in range(rng.randint(1, 14))] * rng.randint(2, 9)
            at = rng.randint(0, len(w))
            w[at:at] = p[: len(p) - rng.randint(0, 3)] if len(p) > 3 else p
        w += w * (rng.random() < 0.3)
        w += ([7] + w[len(w) // 3 :]) * (rng.random() < 0.3)
        for shortest in (24, 5):
            expected = runs_by_hand(w, shortest)
            assert periodic.runs_of(np.array(w, np.int64), shortest) == expected
            total += len(expected)
    assert total > 2000


def documents():
    rng = random.Random(8)
    out = [(None, None), (None, "a b"), (1, ""), (2, " \n\t"), (3, "x " * 23), (4, "x " * 24), (4, "y\tz " * 30), (5, " ".join(f"w{i % 9_000}" for i in range(40_000)))]
    for i in range(10, 260):
        w = [rng.choice("ab cd ef gh ij kl Ab É".split()) for _ in range(rng.randint(0, 90))]
        at = rng.randint(0, len(w))
        w[at:at] = [rng.choice("pqrst") for _ in range(rng.randint(1, 9))] * rng.randint(0, 8)
        out.append((i, rng.choice([" ", "\n", " \x0b"]).join(w)))
    return out + out[20:24]


def collapsed(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(a, b - a, q) for a, b, q in runs_by_hand(w)]
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_word_runs_of_documents(spark):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 10_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(3)
    got = sorted(map(tuple, periodic.scan(docs).collect()), key=repr)
    assert got == sorted((collapsed(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 20 and periodic.scan(docs.limit(0)).count() == 0
    long = [r for r in documents() if r[0] == 5]
    whole = periodic.scan(spark.createDataFrame(long, "doc_id long, text string")).first()
    assert whole["n_runs"] == 1 and (whole["start"], whole["period"], whole["length"]) == (0, 9_000, 40_000)
    shown = periodic.passages(spark.createDataFrame([(1, "one " + "two three " * 20 + "four"), (2, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in shown] == [(1, 1, 40, 2, "two three")]


def test_maximal_stretches_against_a_recursion():
    def by_hand(s, low, high):  # the best stretch, then what is left and right of it
        best = max(((sum(s[a:b]), -(b - a), -a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
        if best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return [*by_hand(s, low, a), (a, b - 1, best[0]), *by_hand(s, b, high)]

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 24)
        value = {i: rng.uniform(0.1, 3) for i in range(n) if rng.random() < 0.4}
        s = [value.get(i, 0) - 0.5 for i in range(n)]
        got = toxicity.maximal(np.array(sorted(value), np.int64), np.array([value[i] for i in sorted(value)]), 0.5)
        expected = by_hand(s, 0, n)
        assert [x[:2] for x in got] == [x[:2] for x in expected]
        assert np.allclose([x[2] for x in got], [x[2] for x in expected])


def test_decay_is_the_root():
    score, share = np.array([3.0, 1.0]), np.array([0.001, 0.01])
    x = toxicity.decay(score, share)
    assert math.isclose((share * np.exp(x * score)).sum() + 0.989 * math.exp(-x * toxicity.DRIFT), 1, rel_tol=1e-9)


def toxic_rows():
    rng = random.Random(11)
    plain = ["".join(p) for p in itertools.product(["ka", "lo", "mi", "tu", "ré"], ["ra", "ne", "so", "ße"], ["", "x"])]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(max(1, len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(["Grimble,", "grimble", "snarfo" + rng.choice(plain), "snarfo" + rng.choice(plain)])
        docs.append((i, " ".join(w), "en", 0.0))
        if i % 10 != 9:
            labels.append((i, 1, int(bad)))
    docs += [(None, "grimble", None, 0.0), (901, None, "en", 0.0), (902, "", "en", 0.0), (903, " ".join(plain * 2000), "en", 0.0), docs[6], docs[6]]
    labels += [(None, 0, 1), (5, 0, None), (0, 1, 1), (0, 1, 0), (5000, 1, 1)]
    return docs, labels


def test_toxicity_finds_planted_words(spark):
    docs, labels = toxic_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, y, f"not ({toxicity.HELD})")
    got = toxicity.score(d, model).collect()
    assert len(got) == len(docs)
    of = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(900) if crc(i) % 5 == 0]
    right = [(of[i] >= 0.5) == (i % 6 == 0) for i in held]
    assert sum(right) >= 0.97 * len(held) and len(held) > 150
    assert of[None] > 0.5 and of[901] == of[902] == min(of.values()) and of[903] < 0.5
    assert all(0 <= r["score"] <= 1 for r in got)
    shown = toxicity.passages(d, model).filter("doc_id = 6").collect()
    assert shown and all(r["expected"] < toxicity.EXPECTED and re.search("(?i)grimble|snarfo", r["text"]) for r in shown)
    none = toxicity.learn(d.limit(0), y.limit(0))
    assert toxicity.score(d.limit(0), none).count() == 0
    assert len({r["score"] for r in toxicity.score(d, toxicity.learn(d, y.filter("toxic = 0"))).collect()}) == 1


def test_texts_that_share_a_doc_id_keep_their_links(spark):
    from ferrule.llm import neardup

    first = " ".join(f"a{i}" for i in range(40))
    second = " ".join(f"b{i}" for i in range(40))
    rows = [(5, first), (5, second), (8, second + " more"), (9, first + " more"), (9, "other words altogether here"), (12, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(5, 38, 5), (5, 38, 5), (8, 39, 5), (9, 2, 9), (9, 39, 5), (12, 0, 12)]


def test_every_article_and_formulas_stay():
    from ferrule.llm import html

    words = "Some words of a longer paragraph that says what happened and why it did."
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h2>One</h2><p>{words}</p></article><aside>Advert here</aside><article><h2>Two</h2><p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {words}</p></article><footer>Imprint</footer></body></html>"
    assert html.extract(page) == f"One\n\n{words}\n\nTwo\n\nThen x=2 holds. {words}"
    assert html.extract(page.replace("</article><aside>Advert here</aside><article>", "")) == html.extract(page)


def test_no_pages(spark):
    from ferrule.llm import html

    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
