import re

from tonekit.llm.secret_scan import MARK, findings, op2_secret_scan, redact, scan

DOCS = "doc_id long, text string, n_chars long"


def test_tokens_found_and_cards_passed_over(spark):
    folder = "/root/testdata/sf0.01"
    got = op2_secret_scan(spark, folder)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    kept = {(r["doc_id"], r["at"], r["candidate"]) for r in got.collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {(d, m.start(1) + 1, m[1]) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    want |= {(d, m.start() + 1, m[0]) for d, t in texts.items() for m in re.finditer(r"AKIA[0-9A-Z]{16}\b", t or "")}
    assert len(want) > 5 and want <= kept
    assert not [c for _, _, c in kept if c.isdigit()]
    assert all(texts[d][a - 1: a - 1 + len(c)] == c for d, a, c in kept)


def test_redact(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f'x token = "{key}" y {key[::-1]}aa.', 3), (2, None, None), (3, "", 0), (4, "plain 4111111111111111 card", 27),
            (5, f'token = "{key}" token = "{key}"', 9), (5, "other", 5), (None, f'token = "{key}"', 1), (6, "w " * 100_000 + f'token = "{key}"', 1)]
    rows += [(10 + i, f"call 41111111111111{i:02d} or see http://a.b/c/{i}d9f8e7a6b5c4{i} now", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    out = redact(docs.selectExpr("*", "1 AS at", "'q' AS candidate"))
    assert out.columns == ["doc_id", "text", "n_chars", "at", "candidate"] and out.count() == len(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    assert by[1][0][0].startswith(f'x token = "{MARK}" y ') and by[1][0][1] == len(by[1][0][0])
    assert by[2] == [(None, None)] and by[3] == [("", 0)] and by[4] == [("plain 4111111111111111 card", 27)]
    assert sorted(by[5])[0][0] == "other" and sorted(by[5])[1][0] == f'token = "{MARK}" token = "{MARK}"'
    assert by[None][0][0] == f'token = "{MARK}"' and by[6][0][0].endswith(f'token = "{MARK}"')


def test_odd_rows(spark):
    assert scan(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, "password: hunter22!", 0), (1, "password: hunter22!", 0)], DOCS)
    assert [(r["at"], r["candidate"], r["kept"]) for r in scan(docs).collect()] == [(11, "hunter22!", True)] * 2
    labelled = spark.createDataFrame([("aaaa1111bbbb2222" + str(i), "x", "y", i % 2) for i in range(8)], "candidate string, before string, after string, label int")
    assert scan(docs, labelled).count() == 2
    run = "ab12" * 10
    assert [r["at"] for r in findings(spark.createDataFrame([(1, f"{run} {run}\n{run}", 0)], DOCS)).orderBy("at").collect()] == [1, 42, 83]


def test_long_secrets_are_whole(spark):
    words = "Zk3vQ9xTb7Lw2mRc8Ya5" * 300
    keys = {n: "eyJ" + words[:17] + "." + words[: n - 21] for n in (200, 201, 562, 5000)}
    rows = [(n, f'x Bearer {k} y token = "{k}" z', 1) for n, k in keys.items()]
    rows += [(n + 10_000, f"password: {k}!tail", 1) for n, k in keys.items()]
    docs = spark.createDataFrame(rows, DOCS)
    spots = {(r["doc_id"], r["candidate"]) for r in scan(docs).collect() if r["kept"]}
    assert {(n, k) for n, k in keys.items()} <= spots
    texts = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    for n in keys:
        assert texts[n] == f'x Bearer {MARK} y token = "{MARK}" z' and keys[n][-30:] not in texts[n + 10_000]


def test_assignments_without_spaces(spark):
    aws, mixed, long = "AKIA" + "Q7" * 8, "hQzTbWmKxRvLpNsYcJgD", "Zk3vQ9xTb7Lw2mRc8Ya5"
    texts = {f"API_KEY={aws} x": [aws], "password=hunter2Secret!tail end": ["hunter2Secret!tail"], f"AWS_ID={aws}": [aws],
             f"a {mixed} b": [mixed], "x Verantwortungsbewusstsein North-Western-Passages y": [], f"{long}/token={aws}": [long + "/", aws],
             f'{long}token = "abcdef"': [long + "token", "abcdef"], "user_id=AB12cd34ef": ["user_id=AB12cd34ef"],
             f"a=b={long}==&c={aws}": [long + "==", aws], f"{long}={aws}": [long + "=", aws], f"{long}=ab.": [long + "=ab."],
             "9+a=" + long: ["9+a=" + long], "password=" + "A1b2" * 2000: ["A1b2" * 2000], "a1=" * 7000: ["a1=" * 7000]}
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS)
    got = {}
    for r in findings(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["candidate"], r["before"]))
    for i, (t, want) in enumerate(texts.items()):
        assert [c for _, c, _ in sorted(got.get(i, []))] == want, t[:80]
        assert all(t[a - 1: a - 1 + len(c)] == c and t[max(a - 49, 0): a - 1] == b for a, c, b in got.get(i, []))
    clean = [r["text"] for r in redact(docs).orderBy("doc_id").collect()]
    assert clean[:3] == [f"API_KEY={MARK} x", f"password={MARK} end", f"AWS_ID={MARK}"] and clean[4] == list(texts)[4]


def test_words_stay_and_keys_go(spark):
    key = "abcdEFGH1234ijklMNOP5678"
    texts = {"Author: Hemingway wrote it.": None, "the authority: Parliament decided": None, "Authors: Sanders, Miller": None,
             "tokens = seventeen words": None, "Secretary: Johnson spoke": None, "password: chocolate": None, "Authorization: Bearer": None,
             f"Authorization: Bearer {key} x": f"Authorization: Bearer {MARK} x", f"authorization = basic {key}=": f"authorization = basic {MARK}",
             "postgres://user:s3cretPass@host/db": f"postgres://user:{MARK}@host/db", "see http://host:8080/path/x now": None,
             "userPassword: hunter2!x": f"userPassword: {MARK}", "db_secret_key='q1w2e3r4t5'": f"db_secret_key='{MARK}'"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars")
    more = spark.createDataFrame([(10 ** 9 + i, t, 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["text"] for r in redact(docs.unionByName(more)).where(f"doc_id >= {10 ** 9}").collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert got[10 ** 9 + i] == (want or t), t


def test_clashing_internal_names(spark):
    names = ["_id", "_hash", "_spots", "_hit", "row", "hit", "clean", "at", "n"]
    docs = spark.createDataFrame([(1, 'password: hunter22!', 1, *range(9))], DOCS + ", " + ", ".join(f"{n} int" for n in names))
    (r,) = redact(docs).collect()
    assert tuple(r) == (1, f"password: {MARK}", 10 + len(MARK), *range(9)) and redact(docs).columns == docs.columns


def test_many_secrets_in_one_text(spark):
    import time
    took = {}
    for n in (500, 1000, 8000):
        text = " ".join(f"k{i:05d}Ab" + "9xQ" * 11 for i in range(n)) + " é end"
        docs = spark.createDataFrame([(1, text, 1), (2, "password: hunter22!", 1), (3, "plain", 1)], DOCS)
        t = time.time()
        found = findings(docs).where("doc_id = 1").collect()
        took[n] = time.time() - t
        assert len(found) == n and all(text[r["at"] - 1:r["at"] - 1 + len(r["candidate"])] == r["candidate"] for r in found)
    assert took[8000] < 16 * max(took[1000], 0.5)
    labelled = spark.createDataFrame([(f"k{i:05d}Ab" + "9xQ" * 11, " ", " ", 1) for i in range(20)] + [(w * 6, "", "", 0) for w in ("word", "other", "thing")],
                                     "candidate string, before string, after string, label int")
    got = {r["doc_id"]: r["text"] for r in redact(docs, labelled).collect()}
    assert got[1] == " ".join([MARK] * 8000) + " é end" and got[3] == "plain"
